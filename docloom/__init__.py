"""docloom: a document-analytics engine written as PySpark DataFrame plans."""
