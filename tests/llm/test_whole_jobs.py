"""Operators held to the whole of their job: what a cut in the method would miss."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docloom.llm import chat_format, jaccard_join, language_id, packing, quality, queries, sharding, spm, warc
from docloom.llm.queries import tokenizer_path


# 1 sharding
def plain_tree(rows, leaves, first, extent):
    """The tree as the docstring states it: rows (sizes, texts, languages, sources, id), sorted and cut one node at a time."""
    if leaves < 2 or not rows:
        return {r[-1]: first for r in rows}
    spread = [(max(r[k] for r in rows) - min(r[k] for r in rows)) / extent[k] for k in range(4)]
    dim = spread.index(max(spread))
    rows = sorted(rows, key=lambda r: (r[dim], r[1], r[4]))
    aim, seen, at = sum(r[0] for r in rows) * (leaves // 2) / leaves, 0, 0
    while seen + rows[at][0] < aim:
        seen, at = seen + rows[at][0], at + 1
    at += seen + rows[at][0] - aim <= aim - seen
    half = leaves // 2
    return plain_tree(rows[:at], half, first, extent) | plain_tree(rows[at:], leaves - half, first + half, extent)


@pytest.mark.parametrize(("shards", "local_rows"), [(16, 20), (7, 1), (16, 1000)])
def test_shards_are_those_of_a_plain_tree(spark, docs, shards, local_rows):
    code = lambda x: zlib.crc32((x if x is not None else "\x00").encode())
    rows = [(len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), code(r.lang), code(r.source), r.doc_id) for r in docs.collect()]
    extent = [max(1, max(r[k] for r in rows) - min(r[k] for r in rows)) for k in range(4)]
    got = {r.doc_id: r.shard for r in sharding.kd_shards(docs, shards=shards, local_rows=local_rows).collect()}
    assert got == plain_tree(rows, shards, 0, extent)


def test_five_thousand_leaves(spark):
    rows = spark.range(20_000, numPartitions=4).selectExpr("id AS doc_id", "repeat('x', cast(id % 97 AS int)) AS text", "cast(id % 3 AS string) AS lang", "cast(id % 1000 AS string) AS source")
    got = sharding.kd_shards(rows, shards=5000, local_rows=3000)
    assert got.count() == 20_000
    sizes = [r.s for r in got.groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "s").collect()]
    assert len(sizes) > 4900 and max(sizes) <= 196 + 200


def test_rows_equal_in_every_key_share_a_shard(spark):
    rows = spark.createDataFrame([(7, "same text", "en", "s")] * 50 + [(None, "moretext.", None, None)] * 50, "doc_id long, text string, lang string, source string").repartition(3)
    for local_rows in (1, 1000):
        got = sharding.kd_shards(rows, shards=8, local_rows=local_rows).collect()
        assert {(r.doc_id, r.shard) for r in got if r.doc_id} == {(7, next(r.shard for r in got if r.doc_id))} and len({r.shard for r in got}) == 2
        assert sorted(r.slot for r in got if r.doc_id) == list(range(50))


# 2 chat
def test_a_null_conversation_id_and_turns_of_null_role(spark):
    rows = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, 0, None, None), (3, 1, "assistant", "")], "conv_id long, turn long, role string, text string").repartition(2)
    got = {r.conv_id: r for r in chat_format.read_chats(chat_format.format_chats(rows)).collect()}
    assert set(got) == {None, 3}
    assert (got[None].n_turns, got[None].loss_chars, got[None].turns_sha256) == (2, 1, hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest())
    assert (got[3].n_turns, got[3].loss_chars, got[3].turns_sha256) == (2, 0, hashlib.sha256(b"\n\nassistant\n\n").hexdigest())


# 4 packing
@pytest.mark.parametrize("migrate", [False, True])
def test_the_search_beats_best_fit_decreasing(spark, migrate):
    """Threes of pieces that fill a sequence exactly: best-fit decreasing misses most of them."""
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(300):
        a = int(rng.integers(520, 900))
        b = int(rng.integers(520, 1648 - a))
        rows += [(len(rows) + k, 0, 0, n, 0) for k, n in enumerate((a, b, 2048 - a - b))]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(pieces, migrate=migrate).collect()
    held = collections.defaultdict(list)
    for r in packed:
        held[r.sequence_id].append((r.offset, r.length))
    assert sorted(r.doc_id for r in packed) == list(range(900))
    for parts in held.values():
        ends = [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts) + 1)]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    plain = packing.best_fit([], sorted((r[3] for r in rows), reverse=True), 2048)
    assert len(held) < len(plain) and len(held) <= len(plain) - (len(plain) - 300) // 5


def test_places_of_null_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (None, "a b c"), (None, "a b c"), (2, "x " * 5000), (2, "x " * 5000)], "doc_id long, text string")
    packed = packing.pack(packing.tokenise(rows, tokenizer_path("byte_bpe_50k.json"))).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) and sum(r.doc_id == 1 and r.length == 1 for r in packed) == 2
    held = collections.Counter()
    for r in packed:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048 and all(r.offset + r.length <= held[r.sequence_id] for r in packed)


# 5 Jaccard
def test_rows_without_ids_link_and_go_by_text(spark):
    text = lambda name, *more: " ".join([*(f"{name}{i}" for i in range(60)), *more])
    rows = [
        (1, text("a")), (None, text("a")), (None, text("b")), (None, text("c")), (None, text("c", "end")), (5, text("d")), (None, text("d", "end")),
        (9, text("a", "end")), (9, text("e")), (None, None), (7, text("f")),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert (None, 57, 5) in found and (None, 57, None) in found
    kept = [tuple(r) for r in jaccard_join.keep_one_each(docs).collect()]
    c = [k for k in kept if k in (rows[3], rows[4])]
    assert len(c) == 1 and sorted(map(str, kept)) == sorted(map(str, [rows[0], rows[2], *c, rows[5], rows[8], rows[9], rows[10]]))


# 6 quality
def test_bands_reject_labelled_junk_in_every_language(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality.quality(docs).join(docs.select("doc_id", "lang"), "doc_id").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    asked, rejected = collections.Counter(), collections.Counter()
    for r in rows.filter("NOT base_failed").select("lang", "quality", "kept").collect():
        asked[r.lang, r.quality] += 1
        rejected[r.lang, r.quality] += not r.kept
    assert {k[0] for k in asked} >= {"de", "en", "es", "fr"}
    for lang in ("de", "en", "es", "fr"):
        assert rejected[lang, 0] >= 0.3 * asked[lang, 0] and rejected[lang, 1] <= 0.04 * asked[lang, 1]


def plain_perplexity(texts):
    """Modified Kneser-Ney as the docstring of the operator states it, with dictionaries; each occurrence is taken out."""
    order = quality.ORDER
    grams = lambda t: [tuple(t[i : i + order]) for i in range(len(t) - order + 1)]
    symbols = {k: [0] * (order - 1) + [0 if c.isspace() else 1 if c.isdigit() else ord(c) for c in t] for k, t in texts.items()}
    tables = {order: collections.Counter(g for t in symbols.values() for g in grams(t))}
    for k in range(order - 1, 0, -1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])
    offs, total, left = {}, collections.Counter(), collections.Counter()
    for k, table in tables.items():
        n1, n2, n3, n4 = (sum(n == i for n in table.values()) for i in (1, 2, 3, 4))
        d = [0.5, 1.0, 1.5]
        if n1 and n2 and n3 and n4:
            y = n1 / (n1 + 2 * n2)
            d = [min(0.95 * i, max(0.05 * i, x)) for i, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)]
        offs[k] = [0.0, *d]
        for g, n in table.items():
            total[k, g[:-1]] += n
            left[k, g[:-1]] += offs[k][min(n, 3)]

    def p(g, out):
        """Probability of the last symbol; ``out``: with one occurrence of ``g`` less."""
        k = len(g)
        if not k:
            return 1 / len(tables[1])
        n, all_, off = tables[k][g], total[k, g[:-1]], offs[k]
        if not out:
            return (n - off[min(n, 3)] + left[k, g[:-1]] * p(g[1:], False)) / all_
        rest = left[k, g[:-1]] - off[min(n, 3)] + off[min(n - 1, 3)]
        if all_ == 1:
            return p(g[1:], True)
        return (n - 1 - off[min(n - 1, 3)] + rest * p(g[1:], n == 1)) / (all_ - 1)

    cost = {g: -np.log(p(g, True)) for g in tables[order]}
    return {k: float(np.mean([cost[g] for g in grams(t)])) for k, t in symbols.items() if len(t) >= order}


@pytest.mark.parametrize("size", [1 << 21, 9_000])
def test_perplexity_and_verdict_are_those_of_a_plain_version(spark, docs, monkeypatch, size):
    monkeypatch.setattr(quality, "SLICE", size)
    held = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op6_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(held)
    for lang in {r.lang for r in held.values()}:
        mine = plain_perplexity({k: r.text or "" for k, r in held.items() if r.lang == lang})
        q1, q3 = (sorted(mine.values())[max(0, int(np.ceil(len(mine) * q)) - 1)] for q in (0.25, 0.75))
        low, high = q1 - quality.SPREADS[0] * max(0.01, q3 - q1), q3 + quality.SPREADS[1] * max(0.01, q3 - q1)
        for k, cost in mine.items():
            assert abs(np.log(got[k].perplexity) - cost) < 1e-4
            if min(abs(cost - low), abs(cost - high)) > 1e-3:
                assert got[k].kept == (not got[k].base_failed and low <= cost <= high)


def test_scripts_have_models_of_their_own_letters(spark):
    """Russian, Greek, Hindi, Chinese: a text of another text's letters in random order stands out."""
    random.seed(4)
    alphabets = {"ru": "абвгдежзик", "el": "αβγδεζηθικ", "hi": "कखगघिीुूेै", "zh": "天地玄黄宇宙洪荒日月"}
    rows, odd = [], {}
    for lang, letters in alphabets.items():
        words = ["".join(random.choice(letters) for _ in range(k % 4 + 3)) for k in range(30)]
        rows += [(len(rows) + k, " ".join(random.choice(words) for _ in range(60)), lang) for k in range(40)]
        odd[len(rows)] = lang
        rows.append((len(rows), " ".join("".join(random.choice(letters) for _ in range(k % 4 + 3)) for k in range(60)), lang))
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(got[k].kept for k in odd) and sum(not got[k].kept for k in got if k not in odd) <= 4


def test_long_texts_are_counted_in_stretches(monkeypatch):
    texts = ["", "ab", "x" * 7, "long text " * 500, "é"]
    whole = [x for codes, owner in quality.stretches(texts) for x in zip(codes.tolist(), owner.tolist())]
    monkeypatch.setattr(quality, "STRETCH", 11)
    assert [x for codes, owner in quality.stretches(texts) for x in zip(codes.tolist(), owner.tolist())] == whole
    assert collections.Counter(o for _, o in whole) == {i: len(t) for i, t in enumerate(texts) if t}


# 8 SentencePiece
def test_every_occurrence_draws_its_own_merges():
    path = tokenizer_path("piece_bpe_32k.model")
    encoder, text = spm.Encoder(path, 1, 0.3), " ".join(["internationalisation", "reading", "words"] * 400)
    ids = encoder.encode([text, text], [5, 6])
    assert [encoder.decode(x) for x in ids] == [text, text] and ids[0].tolist() != ids[1].tolist()
    cuts = {tuple(encoder.encode(["internationalisation"], [d])[0].tolist()) for d in range(100)}
    assert len(cuts) > 20


def plain_pieces(pieces, scores, byte_ids, text, seed, key):
    """Merge-dropout as the docstring states it: one segment, one merge at a time."""
    bits = (1 << 64) - 1

    def mixed(h):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * factor & bits
        return h ^ h >> 31

    odd, golden = "\U0010ffff", 0x9E3779B97F4A7C15
    salt = int.from_bytes(hashlib.blake2b(b"%d/%d" % (seed, key), digest_size=8).digest(), "big")
    ids = []
    for number, segment in enumerate(re.findall("▁+[^▁]*", ("▁" + text.replace("▁", odd).replace(" ", "▁")) if text else "")):
        own, drawn = mixed(salt + number * golden & bits), {}
        parts = [(k, c) for k, c in enumerate(segment)]

        def allowed(i, j, piece):
            if (i, j, piece) not in drawn:
                drawn[i, j, piece] = mixed(own + golden * ((i << 42) + (j << 20) + pieces[piece]) & bits) >= int(spm.DROPOUT * bits)
            return drawn[i, j, piece]

        while True:
            can = [(-scores[x + y], k) for k, ((i, x), (j, y)) in enumerate(zip(parts, parts[1:])) if x + y in pieces and allowed(i, j, x + y)]
            if not can:
                break
            k = min(can)[1]
            parts[k : k + 2] = [(parts[k][0], parts[k][1] + parts[k + 1][1])]
        for _, x in parts:
            ids += [pieces[x]] if x in pieces else [byte_ids[b] for b in x.replace(odd, "▁").encode()]
    return ids


def test_every_text_is_cut_as_a_plain_version_cuts_it(spark, docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    pieces = {sp.id_to_piece(i): i for i in plain}
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    keys = {r.doc_id: r.k for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS k").collect()}
    rows = queries.op8_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts) and all(r.lossless for r in rows)
    for r in rows:
        want = np.array(plain_pieces(pieces, scores, byte_ids, texts[r.doc_id], 1, keys[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(want), zlib.crc32(want.tobytes()))


# 9 WARC
def test_archives_of_other_attempts_are_not_read(spark, tmp_path):
    """A task that ran twice, its rows in another order: the archives of one attempt count."""
    import gzip

    pages = spark.createDataFrame([(k, "u", f"page {k} " * 300) for k in range(40)], "page_id long, url string, html string").repartition(2)
    folder = str(tmp_path / "archives")
    n = warc.write_archives(warc.mark_revisits(pages), folder, archive_bytes=2000, segment_bytes=1000)
    files = sorted((tmp_path / "archives").glob("*.warc.gz"))
    assert len(files) == n > 4
    for f in files[:3]:  # what an attempt that was lost left behind: whole archives, and one cut off
        f.with_name(f.name.replace(".warc.gz", "9.warc.gz")).write_bytes(f.read_bytes())
    (tmp_path / "archives" / "000000-00009-8.warc.gz").write_bytes(gzip.compress(b"WARC/1.1\r\n")[:9])
    assert sorted(r.page_id for r in warc.read_archives(spark, folder).collect()) == list(range(40))
    empty = str(tmp_path / "none")
    assert warc.write_archives(warc.mark_revisits(pages.limit(0)), empty) == 0 and warc.read_archives(spark, empty).count() == 0


# 10 language
def test_words_of_long_texts_are_taken_in_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    table = rng.random((language_id.SIZE, 3)).astype(np.float32)
    texts = ["one two  three", "x" * 500 + " a b " + "y" * 300, " ", "", "12 ab 34", "word " * 400]
    whole = [language_id.word_likelihoods(t, table) for t in texts]
    monkeypatch.setattr(language_id, "BLOCK_CHARS", 7)
    for t, want in zip(texts, whole):
        assert np.allclose(language_id.word_likelihoods(t, table), want, atol=1e-3)


def test_languages_of_one_script_are_told_apart(spark):
    """Words of equal lengths, of letters outside a-z: only the letters tell the languages."""
    random.seed(5)
    alphabets = {"ru": "абвгдежзик", "uk": "єіїґжщюяьф", "el": "αβγδεζηθικ", "hi": "कखगघि\u0940ुूेै", "pl": "ąćęłńśźżwk", "zh": "天地玄黄宇宙洪荒日月", "ja": "のにはをたがでてとし"}
    text = lambda lang: " ".join("".join(random.choice(alphabets[lang]) for _ in range(k % 4 + 3)) for k in range(40))
    rows = spark.createDataFrame([(k, text(lang), lang) for k in range(30) for lang in alphabets], "doc_id long, text string, lang string")
    model = language_id.train(rows)
    new = [(k, text(lang), lang) for k in range(100, 105) for lang in alphabets]
    got = language_id.identify(spark.createDataFrame([(f"{k}{lang}", t) for k, t, lang in new], "doc_id string, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {f"{k}{lang}": lang for k, _, lang in new}
    mixed = text("ru") + " " + text("hi")
    assert set(language_id.identify(spark.createDataFrame([("x", mixed)], "doc_id string, text string"), model).first().lang_set) == {"ru", "hi"}
