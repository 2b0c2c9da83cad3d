import collections
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa

from docloom.llm import language_id, packing
from docloom.llm.queries import tokenizer_path

from .test_operators import plain_components, plain_groups, BLANK


def test_stages_keep_what_plain_versions_keep(spark, docs, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "jaccard_join", "suffix_dedup", "best_fit_packing"]
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    assert len(seen["language_id"]) == sum(any(c.isalpha() for c in r.text or "") for r in docs.collect())
    groups = plain_groups(seen["language_id"].items())
    assert set(seen["exact_dedup"]) == {d for d, t in seen["language_id"].items() if groups[BLANK.sub("", t)][0] == d}
    assert set(seen["jaccard_join"]) == {c for _, c in plain_components(seen["exact_dedup"].items()).values()}
    assert set(seen["suffix_dedup"]) == set(seen["jaccard_join"]) and all(len(seen["suffix_dedup"][d]) <= len(t) for d, t in seen["jaccard_join"].items())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    assert {r.doc_id for r in packed} == set(seen["suffix_dedup"])
    held = collections.Counter()
    for r in packed:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048 and language_id.LEAST_SHARE < 1


def plain_strip(texts, width=400):
    """Texts without the bytes of strings that occur again, cut at whole characters."""
    data = {d: t.encode() for d, t in texts.items()}
    seen = collections.Counter(b[i : i + width] for b in data.values() for i in range(len(b) - width + 1))
    out = {}
    for d, b in data.items():
        spans = []
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + width
                else:
                    spans.append([i, i + width])
        kept, at = b"", 0
        for a, z in spans:
            while a < z and b[a] & 0xC0 == 0x80:
                a += 1
            while z > a and z < len(b) and b[z] & 0xC0 == 0x80:
                z -= 1
            kept, at = kept + b[at:a], z
        out[d] = (kept + b[at:]).decode()
    return out


def test_run_gives_what_plain_versions_give(spark, docs):
    """From documents to places, the stages one after the other, all of it through ``run``."""
    from tokenizers import Tokenizer

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    groups = plain_groups(texts.items())
    texts = {d: t for d, t in texts.items() if groups[BLANK.sub("", t)][0] == d}
    first = {c for _, c in plain_components(texts.items()).values()}
    texts = plain_strip({d: t for d, t in texts.items() if d in first})
    tokenizer, want = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), set()
    for d, t in texts.items():
        ids, at = [*tokenizer.encode(t, add_special_tokens=False).ids, 0], 0
        for k, to in enumerate(range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)):
            want.add((d, k, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())))
            at = to
    assert len(rows) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= 1.01 * -(-sum(r.length for r in rows) // 2048) + 1


def test_stages_send_small_batches(spark, no_docs):
    """Every stage bounds the bytes that a Python worker and its executor hold of texts at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    wide = spark.range(64).coalesce(1).selectExpr("repeat('x', 100000) AS text")
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.set(name, str(64 << 20))
        stage(spark, no_docs, "")
        sizes = wide.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in it), "n long").collect()
        assert max(r.n for r in sizes) < 2.3 * 2**20 and sum(r.n for r in sizes) > 6_400_000


def test_stages_begin_with_a_collection_of_garbage(spark, no_docs):
    """What one stage leaves in the executors' heaps (here the driver's) is gone before the next."""
    management = spark.sparkContext._jvm.java.lang.management.ManagementFactory
    asked = lambda: sum(b.getCollectionCount() for b in management.getGarbageCollectorMXBeans() if "Young" not in b.getName())
    for _, stage in corpus_pipeline.STAGES:
        before = asked()
        stage(spark, no_docs, "")
        assert asked() > before


def test_texts_are_encoded_in_small_blocks():
    """All texts are encoded, half a million characters at a time unless a single text is longer."""
    asked = []

    class Recorder:
        def encode(self, texts):
            asked.append([len(t) for t in texts])
            return [np.zeros(len(t) // 1000, np.uint32) for t in texts]

    packing._encoders["recorder"] = Recorder()
    sizes = [50_000] * 60 + [700_000] + [1_000] * 5
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(sizes))), "text": ["x" * n for n in sizes]})
    rows = [r for b in packing._pieces(iter([batch]), "recorder", 2048, False) for r in b.to_pylist()]
    assert [n for a in asked for n in a] == sizes and [r["length"] for r in rows] == [n // 1000 + 1 for n in sizes]
    assert all(sum(a) <= 1 << 19 or len(a) == 1 for a in asked)
    assert "recorder" not in packing._encoders  # the worker keeps no vocabulary for later stages
