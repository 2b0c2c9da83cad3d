"""Each operator against a plain version, and on odd input."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docloom.llm import _common, chat_format, exact_dedup, jaccard_join, language_id, packing, quality, queries, sharding, spm, suffix_dedup, warc
from docloom.llm._graph import components
from docloom.llm._sais import permuted_common_prefixes, suffix_array
from docloom.llm.queries import tokenizer_path

BLANK = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 1 sharding
def test_shards_are_near_equal_and_slots_gapless(spark, docs, texts):
    rows = sharding.kd_shards(docs, shards=4).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(size) == {0, 1, 2, 3} and max(size.values()) - min(size.values()) <= 2 * max(len(t.encode()) + 1 for t in texts.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_input(odd_docs, no_docs):
    rows = sharding.kd_shards(odd_docs, target_bytes=2000).collect()
    assert len(rows) == 12 and min(r.size for r in rows) == 1 and sharding.kd_shards(no_docs, shards=3).count() == 0


# 2 chat
def test_chats_round_trip(spark):
    says = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "user", says), (1, 1, "assistant", says), (2, 1, "assistant", None), (2, 0, None, "<\\|x <\\\\| é"), (3, None, "a\nb<\\", ""), (4, 0, "user", "x" * 5000), (4, 0, "user", "x" * 5000), (4, 1, "assistant", "y" * 5000)]
    rows = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, part int")
    for part in (64, 1 << 20):
        got = {r.conv_id: r for r in chat_format.read_chats(chat_format.format_chats(rows, part_bytes=part)).collect()}
        for conv in (1, 2, 3, 4):
            mine = sorted([(t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in turns if t[0] == conv])
            loss = "".join(t for _, r, t in mine if r == "assistant")
            g = got[conv]
            assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in mine).encode()).hexdigest()
            assert (g.n_turns, g.loss_chars, g.loss_sha256) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    formatted = chat_format.format_chats(rows.filter("conv_id = 1")).first()
    assert chat_format.parse_chat(formatted.formatted) == [("user", says), ("assistant", says)]
    assert chat_format.read_chats(chat_format.format_chats(rows.limit(0))).count() == 0


# 3 exact dedup
def plain_groups(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), d))
    return {k: (min(v, key=lambda x: (x[0], x[1] if x[1] is not None else 1 << 62))[1], len(v)) for k, v in groups.items()}


def test_exact_dedup(docs, texts):
    want = plain_groups(texts.items())
    for r in exact_dedup.exact_dedup(docs).collect():
        bare = BLANK.sub("", texts[r.doc_id])
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (*want[bare], r.doc_id == want[bare][0], hashlib.sha256(bare.encode()).hexdigest())


def test_exact_dedup_of_odd_input(odd_docs, no_docs):
    rows = exact_dedup.exact_dedup(odd_docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 12 and by[1].keep_id == 2 and by[3].keep_id == 3 and by[4].group_size == 2 and by[7].group_size == 2 and by[None].kept
    kept = exact_dedup.drop_exact_copies(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [2, 3, 5, 6, 7, None, 8, 9, 10]))
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_texts_of_one_digest_are_told_apart_by_their_bytes(spark, docs, texts, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "_digest", lambda bare: F.sha2(F.substring(bare, 1, 1).cast("binary"), 256))
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 3)
    want = plain_groups(texts.items())
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len({r.text_sha256 for r in rows}) < len(want) / 2
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == {d: want[BLANK.sub("", t)] for d, t in texts.items()}
    assert {r.doc_id for r in exact_dedup.drop_exact_copies(docs).collect()} == {d for d, _ in want.values()}


def test_contents_are_found_by_their_locators(spark, docs, texts, tmp_path):
    """Other columns, ids included, do not tell which row a text is: ids are all null or equal."""
    for same in (None, 7):
        frame = spark.createDataFrame([(same, t, k) for k, t in texts.items()], "doc_id long, text string, n long").repartition(3)
        frame.write.mode("overwrite").parquet(f"{tmp_path}/same")
        for source in (frame, spark.read.parquet(f"{tmp_path}/same")):
            kept = [r.text for r in exact_dedup.drop_exact_copies(source).collect()]
            assert sorted(BLANK.sub("", t) for t in kept) == sorted(plain_groups(texts.items()))
    stays = _common.with_locator(spark.read.parquet(f"{tmp_path}/same").filter("n > 3"), f"{tmp_path}/written", "at")
    assert not any("/written/" in f for f in stays.inputFiles()) and stays.select("at").distinct().count() == stays.count()


# 4 packing
def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack(packing.tokenise(docs, path)).collect()
    tokenizer, pieces, sequences = Tokenizer.from_file(path), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, text in texts.items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 0], 0
        for k, r in enumerate(sorted(pieces[d], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())) and (k == 0 or r.length == 2048)
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.01 * -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_of_odd_input(odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack(packing.tokenise(odd_docs, path)).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd_docs.collect()} and sum(r.length for r in rows if r.doc_id == 3) == 1
    want = Tokenizer.from_file(path).encode("<|endoftext|> it's <|im_end|> a▁b", add_special_tokens=False).ids
    assert sum(r.length for r in rows if r.doc_id == 10) == len(want) + 1
    assert packing.pack(packing.tokenise(no_docs, path)).count() == 0


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 400)
    counts = np.bincount(lengths, minlength=100)
    first = packing._start(counts, 100, rng, 0)
    child = packing.crossover(first, packing._start(counts, 100, rng, 1), counts, 100, rng)
    assert sorted(n for b in child for n in b) == sorted(lengths.tolist()) and max(map(sum, child)) <= 100
    assert packing._unpack_bins(packing._pack_bins(child)) == child


# 5 Jaccard
def plain_components(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_jaccard(docs, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()} == plain_components(texts.items())


def test_jaccard_finds_chains_of_edits(spark):
    random.seed(3)
    rows, words = [], [f"w{random.random()}" for _ in range(120)]
    for k in range(60):
        rows.append((k, " ".join(words)))
        words[random.randrange(120)] = f"x{k}"
    rows += [(100 + k, " ".join(f"passage{i}" for i in range(90)) + " " + " ".join(f"own{k}n{i}" for i in range(k % 7 * 4))) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame).collect()} == plain_components(rows)


def test_jaccard_of_odd_input(odd_docs, no_docs):
    rows = jaccard_join.jaccard_components(odd_docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 12 and (by[2].component_id, by[6].component_id, by[3].component_id, by[4].n_shingles, by[8].n_shingles) == (1, 5, 3, 0, 1)
    kept = jaccard_join.keep_one_each(odd_docs)
    assert kept.columns == odd_docs.columns and not {2, 6} & {r.doc_id for r in kept.collect()} and jaccard_join.jaccard_components(no_docs).count() == 0


def test_components(spark, tmp_path):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 130)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path)).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[i] == 100 for i in range(100, 130))


# 6 quality
def test_base_counts(texts):
    for text in [*list(texts.values())[:60], "a b\na b\n \n a b", "é # | é", " ".join("abcdefgh" * 3)]:
        words = WORD.findall(text)
        windows = collections.defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i : i + 8])].append(i)
        covered = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert quality.base_counts(text) == want


def test_quality_keeps_prose_and_drops_noise(spark, docs, odd_docs, no_docs):
    noise = spark.createDataFrame([(-1, " ".join("zxq|wvk zzz||qqx jjw" for _ in range(1)) + " " + " ".join(f"q{i}x|z#k{i}" for i in range(60)), "en")], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in quality.quality(docs.select("doc_id", "text", "lang").unionByName(noise)).collect()}
    assert not rows[-1].kept and sum(r.kept for r in rows.values()) > 0.8 * len(rows)
    odd = quality.quality(odd_docs).collect()
    assert len(odd) == 12 and all(r.base_failed for r in odd if r.doc_id in (3, 4, 8)) and quality.quality(no_docs).count() == 0


# 7 suffix dedup
def plain_removal(rows, width):
    seen = collections.Counter(b[i : i + width] for _, b in rows for i in range(len(b) - width + 1))
    out = []
    for d, b in rows:
        hit = np.zeros(len(b) + 1, int)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                hit[i : i + width] = 1
        spans = int((np.diff(np.concatenate([[0], hit])) == 1).sum())
        out.append((d, len(b), int(hit.sum()), spans, hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest()))
    return out


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for t in range(600):
        s = np.tile(rng.integers(0, (1, 2, 3, 30, 2000)[t % 5], rng.integers(1, 50)).astype(np.int32), t % 3 + 1)
        at = s.tolist()
        order = sorted(range(len(at)), key=lambda i: at[i:])
        assert suffix_array(s).tolist() == order
        want = [0] * len(at)
        for a, b in zip(order, order[1:]):
            while want[b] < 9 and max(a, b) + want[b] < len(at) and at[a + want[b]] == at[b + want[b]]:
                want[b] += 1
        assert permuted_common_prefixes(s, np.array(order), 9).tolist() == want


def test_suffix_dedup(docs, texts):
    got = sorted(tuple(r)[:5] for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted(plain_removal([(d, t.encode()) for d, t in texts.items()], 400))


@pytest.mark.parametrize("hot", [1, 2, 10_000])
def test_suffix_dedup_of_hot_passages(spark, monkeypatch, hot):
    random.seed(1)
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    passage = "".join(random.choice("abcé ") for _ in range(500))
    rows = [(k, "".join(random.choice("xyz ") for _ in range(random.randrange(300))) + passage[random.randrange(40) :] + "".join(random.choice("xyz") for _ in range(90))) for k in range(30)] + [(90, "ab" * 600)]
    got = sorted(tuple(r)[:5] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(plain_removal([(d, t.encode()) for d, t in rows], 400))


def test_a_passage_of_very_many_documents_is_split(spark, monkeypatch):
    """5000 documents hold one long passage, each between text of its own: no shard gets its contexts."""
    random.seed(2)
    own = lambda n: "".join(random.choice("klmnopqrst ") for _ in range(n))
    passage = own(600)
    rows = [(k, own(60) + passage + own(60 if k % 10 else 6)) for k in range(5000)] + [(5000 + k, own(900)) for k in range(50)]
    shards = suffix_dedup._shards

    def watched(batches, width):
        def seen():
            for batch in batches:
                anchors = batch.column("anchor").to_pylist()
                assert max((anchors.count(a) for a in set(anchors)), default=0) <= suffix_dedup.HOT_CONTEXTS
                yield batch

        yield from shards(seen(), width)

    monkeypatch.setattr(suffix_dedup, "_shards", watched)
    got = sorted(tuple(r)[:5] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    # all strings that lie in the passage repeat, and by chance a few bytes around it; the others are random
    assert got == sorted(plain_removal([(d, t.encode()) for d, t in rows], 400))


def test_suffix_dedup_of_odd_input(odd_docs, no_docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd_docs.collect()]
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted([tuple(r)[:5] for r in suffix_dedup.remove_repeats(odd_docs).collect()], key=key) == sorted(plain_removal(rows, 400), key=key)
    stripped = suffix_dedup.strip_repeats(odd_docs)
    assert stripped.columns == odd_docs.columns and all(r.n_chars == len(r.text) for r in stripped.collect() if r.text is not None)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


# 8 SentencePiece
def test_spm_is_the_library_without_dropout_and_lossless_with(docs, texts, odd_docs, no_docs):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library, some = sentencepiece.SentencePieceProcessor(model_file=path), [*list(texts.values())[:80], "", " ", "  a  b", "日本 x" * 40, "x" * 200, "<0x0A>"]
    assert [x.tolist() for x in spm.Encoder(path, 0, 0.0).encode(some, list(range(len(some))))] == library.encode(some)
    a, b = (spm.Encoder(path, seed, 0.3).encode(some, list(range(len(some)))) for seed in (1, 2))
    assert any(x.tolist() != y.tolist() for x, y in zip(a, b)) and [spm.Encoder(path).decode(x) for x in a] == some
    rows = spm.encode(odd_docs, path).collect()
    assert len(rows) == 12 and all(r.lossless for r in rows) and spm.encode(no_docs, path).count() == 0


def test_spm_arrays_agree_with_the_heap():
    model = spm.Model(tokenizer_path("piece_bpe_32k.model"))
    for k, word in enumerate(["▁hello", "▁reading", "▁aaaaaaaa", "▁été123", "▁internationalisation"]):
        symbols = model.symbols(np.array([ord(c) for c in word], np.uint32))
        for rate in (0.0, 0.3):
            key = np.array([k * 77 + 5], np.uint64)
            done, left = spm.merge_many(model, symbols[None, :], key, rate)
            assert done[left].tolist() == spm.merge_long(model, symbols, key[0], rate)


# 9 WARC
def test_warc_round_trip(spark, tmp_path):
    big = "".join(f"<p>{i} é</p>" for i in range(9000))
    rows = [(1, "http://a/é", big), (2, "u", big), (3, None, "short"), (4, "u", "short"), (5, "u\nx", None), (6, "u", "z" * 100), (6, "u", "z" * 100), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "b") for r in rows], "page_id long, url string, html string, block string")
    warc.write_archives(warc.mark_revisits(pages), str(tmp_path), segment_bytes=1000, archive_bytes=5000)
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next((h or "") for i, _, h in rows if i == r.page_id)
        first = {big: 1}.get(html)
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first) if first and r.page_id != first else ("response", None))
        assert r.record_type == "revisit" or bytes(r.payload) == html.encode()


def test_warc_refuses_missing_segments(spark, tmp_path):
    import gzip

    parts = list(warc.records(1, "u", "0" * 64, b"x" * 5000, 5000, None, "n", 1000))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts[:2] + parts[3:]))
    with pytest.raises(Exception, match="segments are missing"):
        warc.read_archives(spark, str(tmp_path)).collect()
    assert warc.unchunked(warc.chunked(b"abc" * 5000)) == b"abc" * 5000


# 10 language
def test_language(docs, odd_docs, no_docs):
    model = language_id.train(docs.filter(~language_id.held_out()))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in language_id.identify(docs, model).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in language_id.identify(odd_docs, model).collect()}
    assert odd[3].lang_pred == odd[4].lang_pred == odd[8].lang_pred == "und" and odd[7].lang_pred == "fr"
    assert language_id.identify(odd_docs, language_id.train(no_docs)).first().lang_pred == "und" and language_id.identify(no_docs, model).count() == 0
    kept = language_id.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and not {3, 4, 8} & {r.doc_id for r in kept.collect()}


def test_a_mixture_has_both_languages():
    words = np.log(np.array([[0.9, 0.05, 0.05]] * 60 + [[0.05, 0.9, 0.05]] * 40))
    share, chosen = language_id.mixture(words)
    assert chosen == [0, 1] and share[0] > share[1] > share[2]


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
