"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations, repeat

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexgrove.llm import bag_ranking, collocations, common, components, crf, decontaminate, language_crf, line_spread, personal_data, piece_codec, queries, queries_sql, simhash, suffix_dedup, toxicity, url_filter, vector_topk, wavelet

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
rng = random.Random(5)


def words(n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


LONG = words(4000)
TEXTS = [
    (1, "The same text twice. " * 8), (2, "The same text twice. " * 8), (3, None), (4, ""), (5, " \n\t "), (6, "a"), (7, LONG), (8, LONG + " tail"),
    (9, "ünï cødé 中文 😀 é ﬁ ▁ \u0000 x"), (10, "12 34 !!! ..."), (None, "no id here at all"), (11, "  two  spaces "), (11, "  two  spaces "), (12, "one two"),
    (13, "<|endoftext|> it's we'll ΣΑΣ"), (14, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i and i % 2 else None, None if i == 6 else f"s{(i or 0) % 3}", None) for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


CLASH = ["id", "row", "whole", "body", "kept", "gone", "rest", "t", "w", "h", "_id", "fp", "keep", "n_lines", "lang_pred", "score", "item_id", "line", "key"]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


def table(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# --- URL filter ------------------------------------------------------------------------------


def test_url_filter(spark, tmp_path):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en/", "http://example.com/EN/", "http://a.net/es/x", "http://net/es/", "http://xnet/es/", "http://a.org", "http://a.com", "ftp://x.spam-farm.example.org/q", "http://a.example.com?q://b/c", "http://a.org/" + "b/" * 50]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    keys = spark.createDataFrame([*queries.URL_RULES, *((k, url_filter.LISTED) for k in queries.LISTED_KEYS), (None, 0), ("com/", url_filter.ALLOW)], "key string, kind int")
    files = url_filter.build_digests(keys, str(tmp_path / "few"))
    many = url_filter.build_digests(keys, str(tmp_path / "many"), file_keys=4)
    assert len(files) == 1 and len(many) > 1
    tops = [url_filter.DigestFile(f).digests for f in many]
    assert all(a[-1] < b[0] for a, b in zip(tops, tops[1:]))
    expected = []
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u[u.index("://") + 3 :]
            k = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:k].lower(), rest[k:]
            path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
        fits = [(r, v) for r, v in queries.URL_RULES if (lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p))(r.split("/")[0], r[r.index("/") :])]
        rule = max(fits, key=lambda x: len(x[0]), default=None)
        listed = any((host == k[:-1] or host.endswith("." + k[:-1])) and path.startswith("/") for k in queries.LISTED_KEYS)
        expected.append((i, host, path, rule and rule[0], url_filter.VERDICTS[rule[1]] if rule else "block" if listed else "allow"))
    for own in (files, many):
        assert table(url_filter.judge_urls(pages, own), "page_id", "host", "path", "rule", "verdict") == sorted(expected, key=str)
    assert url_filter.judge_urls(pages.limit(0), files).count() == 0
    assert url_filter.judge_urls(pages, url_filter.build_digests(keys.limit(0))).where("verdict = 'block'").count() == 0


def test_digest_collision_is_settled_by_the_string(tmp_path):
    url_filter.write_digest_file(f"file://{tmp_path}/d", ["a.com/", "b.com/"], [url_filter.BLOCK, url_filter.LISTED])
    f = url_filter.DigestFile(f"file://{tmp_path}/d")
    digest = np.array([xxhash.xxh64_intdigest(b"a.com/", url_filter.SEED)] * 2, np.uint64)
    assert f.probe(digest, [b"a.com/", b"other/"]).tolist() == [url_filter.BLOCK, -1]


# --- token shards ----------------------------------------------------------------------------


def test_wavelet_answers():
    ids = np.random.default_rng(1).integers(0, 49409, 5000).astype(np.uint16)
    ids[::7] = 42
    shard = wavelet.WaveletShard(wavelet.build_shard(ids, np.array([3, 9]), np.array([2000, 3000]), 16))
    assert (shard.ids() == ids).all() and shard.doc_ids.tolist() == [3, 9]
    for i in (0, 511, 512, 513, 4999):
        assert shard.access(i) == ids[i]
    for token in (42, int(ids[1]), 49408, 70000):
        places = np.flatnonzero(ids == token)
        assert shard.rank(token) == len(places) and shard.rank(token, 2500) == (places < 2500).sum()
        assert [shard.select(token, k) for k in range(min(5, len(places)))] == places[:5].tolist()
    with pytest.raises(IndexError):
        shard.select(42, 10**6)
    empty = wavelet.WaveletShard(wavelet.build_shard(ids[:0], np.empty(0), np.empty(0), 16))
    assert empty.ids().tolist() == [] and empty.rank(3) == 0


def odd_texts(n):
    letters = "abct heè éÀß.,'\"\n\t 012▁中😀\u0301\u00a0\x1cİΣ<|>s"
    return ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(n)]


def test_encoder_equals_library():
    encoder, library = wavelet.Encoder(WORD_FILE), Tokenizer.from_file(WORD_FILE)
    texts = [t for _, t in TEXTS if t is not None] + odd_texts(500)
    ids, counts = encoder.encode([t.encode() for t in texts], 2)
    cut = np.split(ids, np.cumsum(counts)[:-1])
    for t, own in zip(texts, cut, strict=True):
        assert own.tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], t


def test_encoder_reads_punctuated_words_as_plain_ones(monkeypatch):
    """Words go to the model directly whatever ASCII punctuation follows; each such ending goes through the whole pipeline once."""
    encoder, library = wavelet.Encoder(WORD_FILE), Tokenizer.from_file(WORD_FILE)
    seen, whole = [], encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda pieces: seen.extend(pieces) or whole(pieces))
    texts = ["One.### two$$$ ÉTÉ!! don't x' 's l'été a<|b|> a|> <|endoftext|> It's.", "three.### four' five's", "a\u0301.## \u00a0b.. \x1cc,, ß$ İ!"]
    raw = [t.encode() for t in texts] + [b"b\xff.# c\xe4\xb8 d"]
    ids, counts = encoder.encode(raw, 2)
    for t, own in zip(raw, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == [*library.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, 2], t
    assert seen.count(".###") == 1 and not {"One.###", "two$$$", "ÉTÉ!!", "three.###"} & set(seen)


def test_encoder_keeps_words_that_come_again(monkeypatch):
    """A word goes to the library once, whatever case it has, whatever follows it and however many other words were met since."""
    monkeypatch.setattr(wavelet, "MEMO_ENTRIES", 40)
    encoder, library = wavelet.Encoder(WORD_FILE), Tokenizer.from_file(WORD_FILE)
    plain, seen = encoder.plain, []

    class Counting:
        def encode_batch_fast(self, lines, **options):
            seen.extend(lines[0].split())
            return plain.encode_batch_fast(lines, **options)

    encoder.plain = Counting()
    for k in range(30):
        texts = [f"Often, often; OFTEN été été.## {words(8, 'klmnopqr')}", "", f"<|startoftext|> often<|endoftext|>.{k}"]
        ids, counts = encoder.encode([t.encode() for t in texts], 2)
        for t, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], t
    assert seen.count("often") == 1 and sum(w.startswith("Ã") for w in seen) == 1


def test_encoder_cuts_where_tokens_end():
    """Cut words, lower case and special tokens give the ids of the whole text: marks that compose with small letters only, names of special tokens in capitals."""
    encoder, library = wavelet.Encoder(WORD_FILE), Tokenizer.from_file(WORD_FILE)
    parts = ["H\u0331", "h", "J\u030c.", "A\u030a", "<|endoftext|>", "<|EndOfText|>", "<|startoftext", "|>", "<", "it's", "IT'S", "L'ÉTÉ", "x'll.", "é.", "É", "ß,", "×.", "÷", "İ", "K", "ÿ!?", "a_b", "7.5", "\x1c", "\x7f", "\u0345", " ", " ", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(3000)]
    for batch in (texts[:1000], texts[1000:1001], texts[1001:]):
        ids, counts = encoder.encode([t.encode() for t in batch], 2)
        bare, fewer = encoder.encode([t.encode() for t in batch])
        assert (counts - 1).tolist() == fewer.tolist() and (ids[ids != 2] == bare[bare != 2]).all()
        for t, own in zip(batch, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], t
    for batch in ([], [b""], [b" \n", b""], [b"", b" a"]):
        ids, counts = encoder.encode(batch)
        assert len(counts) == len(batch) and ids.tolist() == [i for t in batch for i in library.encode(t.decode(), add_special_tokens=False).ids]


def test_shards_end_with_the_document_that_fills_them(spark, tmp_path):
    df = spark.createDataFrame([(k, words(1 + k % 30)) for k in range(400)], "doc_id long, text string")
    got = wavelet.corpus_ids(df, WORD_FILE, str(tmp_path / "shards"), shard_tokens=500)
    longest, shards = max(r.n_tokens for r in got.collect()), spark.read.parquet(str(tmp_path / "shards")).collect()
    last = {p: max(s.seq for s in shards if s.part == p) for p in {s.part for s in shards}}
    assert all(s.n_tokens < 500 + longest and (s.n_tokens >= 500 or s.seq == last[s.part]) for s in shards) and sum(s.n_docs for s in shards) == 400


def test_corpus_ids(spark, docs, none):
    library = Tokenizer.from_file(WORD_FILE)
    expected, start = [], 0
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = wavelet.corpus_ids(clashing(docs), WORD_FILE, shard_tokens=50)
    assert table(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=str)
    assert wavelet.corpus_ids(none, WORD_FILE).count() == 0


def test_texts_of_one_id_have_an_order(spark):
    rows = [(None if k % 2 else 7, words(1 + k % 30)) for k in range(200)]
    one, other = (spark.createDataFrame(r, "doc_id long, text string").repartition(n) for r, n in ((rows, 3), (rows[::-1], 7)))
    got = [table(wavelet.corpus_ids(d, WORD_FILE, shard_tokens=200), "doc_id", "start", "n_tokens", "ids_crc32") for d in (one, other)]
    assert got[0] == got[1] and len(got[0]) == 200
    starts = sorted((s, n) for _, s, n, _ in got[0])
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:]))


def test_many_ranges_share_shard_files(spark, tmp_path):
    """Few files however many ranges there are, and the same rows as from one range; one id fills several ranges."""
    rows = [(k // 40, words(1 + k % 9)) for k in range(900)] + [(11, words(3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    got = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 150):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(table(wavelet.corpus_ids(df, WORD_FILE, f"{tmp_path}/{n}", shard_tokens=300), "doc_id", "start", "n_tokens", "ids_crc32"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files, tasks = len(list((tmp_path / "150").glob("*.parquet"))), max(wavelet.TASKS_PER_CORE * spark.sparkContext.defaultParallelism, 150 // wavelet.RANGES_PER_TASK)
    assert got[0] == got[1] and len(got[0]) == 1100
    assert 0 < files <= tasks < spark.read.parquet(f"{tmp_path}/150").select("part").distinct().count()


# --- pieces ----------------------------------------------------------------------------------


def test_piece_codec_equals_library():
    codec, library = piece_codec.codec_of(PIECE_FILE), sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    texts = [t for _, t in TEXTS if t is not None] + odd_texts(500) + ["a" * 3000, " " * 99 + "b" + " " * 7, "ab" * 500 + "中" * 50]
    for t in texts:
        ids = codec.encode(t.encode()).tolist()
        assert ids == library.encode(t), t
        assert codec.decode(ids).decode() == library.decode(ids), t


def test_compatible_pairs_need_no_merging(monkeypatch):
    """Neighbours are judged by taking merges back, and as merging the joined text judges them."""
    codec = piece_codec.PieceCodec(PIECE_FILE)
    known = sorted(set(codec.shorter) - codec.unordered)
    pairs = [(rng.choice(known), rng.choice(known)) for _ in range(1000)]
    for text in (codec.text[i] for i in rng.choices(known, k=3000)):
        parts = [codec.id.get(x) for x in (text[: len(text) // 2], text[len(text) // 2 :])]
        pairs += [tuple(parts)] if set(parts) <= set(known) else []
    pairs += [(codec.id[x * k], codec.id[x * m]) for x in "se" for k in (1, 2) for m in (1, 2) if {x * k, x * m} <= set(codec.id)]
    expected = [codec.merge(codec.text[a] + codec.text[b]) == [a, b] for a, b in pairs]
    assert 500 < sum(expected) < len(expected) - 500
    monkeypatch.setattr(codec, "merge", lambda *_: pytest.fail("merged"))
    assert [codec.compatible(a, b) for a, b in pairs] == expected


def test_round_trip(docs, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    expected = []
    for i, t in TEXTS:
        ids = library.encode(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = piece_codec.round_trip(clashing(docs), PIECE_FILE, [F.col("doc_id")])
    assert table(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=str)
    assert piece_codec.round_trip(none, PIECE_FILE, [F.col("doc_id")]).count() == 0


# --- conditional random field -----------------------------------------------------------------


def test_word_memory_scores_a_word_once(monkeypatch):
    """Pieces of one word are scored once, also after the memory is full, and marginals do not depend on how texts are dealt."""
    model = crf.Crf(3, {})
    for x in (model.weights, model.trans, model.start):
        x[:] = np.random.default_rng(5).normal(size=x.shape)
    texts = [b"one two, three", b"", b"Two four one. (one)", b"five six seven eight nine ten one", b"ten"] * 3
    gamma, letters, sizes = crf.marginals(model, "wide", texts)
    asked, held, score, run = [], [], crf.Crf.score, crf.forward_backward
    monkeypatch.setattr(crf, "MEMO_WORDS", 8)
    monkeypatch.setattr(crf, "WORDS_AT_ONCE", 5)
    monkeypatch.setattr(crf.Crf, "score", lambda self, words: asked.extend(words) or score(self, words))
    monkeypatch.setattr(crf, "forward_backward", lambda scores, sizes, *rest: held.append((len(scores), len(sizes))) or run(scores, sizes, *rest))
    for _ in range(3):
        got = crf.marginals(model, "narrow", texts)
        assert np.allclose(got[0], gamma, atol=1e-6) and (got[1] == letters).all() and (got[2] == sizes).all()
    assert len(asked) == len(set(asked)) == 10
    assert all(n <= 5 or texts == 1 for n, texts in held)


def test_word_memory_is_short_inside_a_batch(monkeypatch):
    """One batch of many new words does not outgrow the word memory, and its marginals are the same."""
    model = crf.Crf(3, {})
    for x in (model.weights, model.trans, model.start):
        x[:] = np.random.default_rng(6).normal(size=x.shape)
    texts = [b"", *(words(20, "abcdefghij").encode() for _ in range(60)), b"", words(300).encode()]
    gamma, letters, sizes = crf.marginals(model, "whole", texts)
    most, learn = [], crf.WordScores.learn
    monkeypatch.setattr(crf, "MEMO_WORDS", 200)
    monkeypatch.setattr(crf, "WORDS_ASKED", 50)
    monkeypatch.setattr(crf.WordScores, "learn", lambda self: (learn(self), most.append(len(self) + len(self.older)))[0])
    got = crf.marginals(model, "parts", texts)
    assert np.allclose(got[0], gamma, atol=1e-6) and (got[1] == letters).all() and (got[2] == sizes).all()
    # A slice, here at most of 50 words and one text, may come on top of each half.
    assert max(most[:-1]) <= 200 + 2 * 70 < len({w for t in texts for w in t.split()})
    assert crf.marginals(model, "none", [])[0].shape == (0, 3)


def test_another_model_gives_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "_HELD", {})
    monkeypatch.setattr(common, "give_back", lambda: given.append(len(common._HELD)))
    held = [common.worker_held("kind", key, lambda: [key]) for key in "aab"]
    assert held == [["a"], ["a"], ["b"]] and held[0] is held[1] and given == [0] and list(common._HELD) == [("kind", "b")]
    common.drop_held()
    common.drop_held()
    assert given == [0, 0] and not common._HELD


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(2)
    sizes, labels = [3, 0, 1, 4], 3
    scores, start, trans = r.normal(size=(8, labels)), r.normal(size=labels), r.normal(size=(labels, labels))
    gamma, pairs, log_z = crf.forward_backward(scores, np.array(sizes), start, trans, pairs=True)
    want, want_pairs, want_z, at = np.zeros((8, labels)), np.zeros((labels, labels)), 0.0, 0
    for n in sizes:
        total, own, moves = 0.0, np.zeros((n, labels)), np.zeros((labels, labels))
        for path in np.ndindex(*([labels] * n)) if n else []:
            p = np.exp(start[path[0]] + sum(scores[at + t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, y in enumerate(path):
                own[t, y] += p
            for a, b in zip(path, path[1:]):
                moves[a, b] += p
        if n:
            want[at : at + n], want_z = own / total, want_z + np.log(total)
            want_pairs += moves / total
        at += n
    assert np.allclose(gamma, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def test_language_held_out_accuracy_and_edges(spark, sf, docs, none):
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_crf.identify(whole).join(whole.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r.lang_pred == r.lang for r in got) / len(got) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)
    held = {i for i in range(20) if zlib.crc32(str(i).encode()) % 3 == 1}
    edge = {(r.doc_id, r.held_out, r.lang_pred) for r in language_crf.identify(clashing(docs)).collect()}
    assert {(3, 3 in held, "und"), (4, 4 in held, "und"), (5, 5 in held, "und"), (10, 10 in held, "und")} <= edge
    assert (None, False, "en") in edge and (7, 7 in held, "en") in edge
    assert language_crf.identify(none).count() == 0
    unlabelled = language_crf.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_toxicity_held_out_accuracy_and_edges(spark, docs, none):
    sf = "/root/testdata/sf0.1"
    whole, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.judge(whole, labels, spans=True).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score", "spans").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert len(got) > 1000 and hit / sum(r.toxic for r in got) >= 0.9 and hit / sum(r.predicted for r in got) >= 0.9
    assert sum(bool(r.spans) for r in got if r.toxic and r.predicted) >= 0.95 * hit
    few = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (7, 0, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    edge = toxicity.judge(clashing(docs), few).collect()
    assert len(edge) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in edge)
    assert toxicity.judge(none, few).count() == 0
    assert {r.score for r in toxicity.judge(docs, few.limit(0)).collect()} == {0.5}


# --- suffixes --------------------------------------------------------------------------------


def brute_repeats(rows, length):
    """Rows of (id, text) in order -> id: (bytes, removed, runs, hash of the rest)."""
    seen, out = set(), {}
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), sum(1 for j in range(len(t)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "range_rows"), [(10**9, 10**9), (10**9, 40), (4, 60)])
def test_suffix_dedup_equals_brute_force(spark, hot, range_rows):
    own = random.Random(hot + range_rows)
    text = lambda n: bytes(own.choices(b"abcdefgh ", k=n))
    line, base, rows = text(25), [text(own.randint(0, 300)) for _ in range(20)], []
    for i in range(80):
        t = bytearray(own.choice(base) if i % 2 else text(own.randint(0, 200)))
        for _ in range(own.randint(0, 3) if t else 0):
            t[own.randrange(len(t))] = own.choice(b"xyz")
        k = own.randrange(len(t) + 1)
        rows.append((i, bytes(t[:k]) + (line if i % 3 else b"") + bytes(t[k:]) + (b"a" * 40 if i % 11 == 0 else b"")))
    want = brute_repeats(rows, 20)
    df = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string").repartition(4)
    got = suffix_dedup.dedup_substrings(df, 20, 11, hot, range_rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == want


def test_suffix_dedup_edges(docs, none):
    got = table(suffix_dedup.dedup_substrings(clashing(docs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    distinct = sorted(dict.fromkeys((i, (t or "").encode()) for i, t in TEXTS), key=lambda r: (r[0] is not None, r[0] or 0))
    want = brute_repeats(distinct, 100)
    assert got == sorted(((i, *want[i]) for i, _ in TEXTS), key=str)
    assert suffix_dedup.dedup_substrings(none).count() == 0


def test_multikey_sort():
    rows = np.random.default_rng(0).integers(97, 99, (500, 19)).astype(np.uint8)
    order = suffix_dedup.multikey_sort(rows)
    own = [bytes(rows[i]) for i in order]
    assert own == sorted(map(bytes, rows))
    lcp = suffix_dedup.common_prefix(rows, order)
    assert all(lcp[k] == next((j for j in range(19) if own[k][j] != own[k - 1][j]), 19) for k in range(1, 500))


# --- SimHash ---------------------------------------------------------------------------------


def brute_print(text, size=3):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    h = list(map(xxhash.xxh64_intdigest, shingles, repeat(42)))
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(prints):
    """[(id, print)] -> id: least id reachable over 2 bits."""
    root = {p: p for _, p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return {(i, p): least.get(find(p)) for i, p in prints}


@pytest.mark.parametrize("pair_limit", [48, 1])
def test_simhash_equals_brute_force(spark, docs, pair_limit):
    base, rows = words(300).split(), list(TEXTS)
    for i in range(100, 180):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = "changed"
        rows.append((i, " ".join(own)))
    prints = [(i, brute_print(t)) for i, t in rows]
    want = brute_roots(prints)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.linked_groups(clashing(df), pair_limit=pair_limit)
    assert table(got, "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id") == sorted(((i, f"{p:016x}", want[i, p]) for i, p in prints), key=str)


def test_simhash_links_random_neighbours(spark):
    own = random.Random(3)
    near = [own.getrandbits(64) for _ in range(20)]
    near += [p ^ sum(1 << b for b in own.sample(range(64), own.randint(1, 4))) for p in near for _ in range(10)]
    signed = [p - (1 << 64) if p >> 63 else p for p in near]
    for limit in (48, 1):
        edges = simhash.linked_edges(spark.createDataFrame([(p,) for p in set(signed)], "fp long"), pair_limit=limit)
        found = {r.node: r.root for r in components.components(edges).collect()}
        want = brute_roots([(i, p) for i, p in enumerate(near)])
        groups = lambda key: {frozenset(i for i in range(len(near)) if key(i) == k) for k in map(key, range(len(near)))}
        assert groups(lambda i: found.get(signed[i], signed[i])) == groups(lambda i: want[i, near[i]])


def test_near_dedup_keeps_one_of_each_group(spark, docs, none):
    base = [words(200) for _ in range(4)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(base)]
    for k in range(4, 204):
        own = base[k % 4].split()
        own[rng.randrange(len(own))] = f"edit{k}"
        rows.append((k, " ".join(own), "en", "s", 1))
    kept = simhash.near_dedup(spark.createDataFrame(rows, DOCS))
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [0, 1, 2, 3]
    edge = clashing(docs)
    out = simhash.near_dedup(edge)
    assert out.columns == edge.columns
    left = [r.doc_id for r in out.collect()]
    assert 1 in left and 2 not in left and 7 in left and 8 not in left and len({3, 4, 5, 14} & set(left)) == 1
    assert simhash.near_dedup(none).count() == 0


def of_words(text, size=5):
    w = text.split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def alike(a, b):
    return len(of_words(a) & of_words(b)) / len(of_words(a) | of_words(b))


def test_similarity_is_decided_by_the_shingles_themselves(spark):
    rows, want = [], set()
    for k in range(150):
        own = [f"w{k}x{i}" for i in range(104)]
        # The last 11 of 100 shingles changed leave 0.802, the last 12 leave 0.786.
        kept = 93 - k % 2
        copy = own[:kept] + [f"w{k}z{i}" for i in range(kept, 104)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(copy))]
        want |= {2 * k} if alike(*(t for _, t in rows[-2:])) >= 0.8 else {2 * k, 2 * k + 1}
    got = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 150 < len(want) < 300 and got == want


def test_repeated_passages_do_not_part_near_copies(spark):
    rows = []
    for k in range(40):
        text, often = [f"w{k}x{i}" for i in range(200)], [f"w{k}x{i}" for i in range(50, 70)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text + often * 50))]
    bits = [simhash.simhash64(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows]
    assert any((bits[i] ^ bits[i + 1]).bit_count() > 24 for i in range(0, 80, 2)) and alike(rows[0][1], rows[1][1]) > 0.88
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(range(0, 80, 2))


@pytest.mark.parametrize("share", [150, 172])
def test_near_copies_in_a_crowd_with_a_common_passage(spark, share):
    passage = [f"p{i}" for i in range(share)]
    rows = []
    for k in range(140):
        own = [f"w{k}x{i}" for i in range(204 - share)]
        rows.append((k, " ".join(passage + own)))
        if k % 4 == 0:  # 0.83 to the one before it
            rows.append((1000 + k, " ".join(passage + own[:-18] + [f"w{k}y{i}" for i in range(18)])))
    texts = dict(rows)
    assert alike(texts[1], texts[2]) < 0.8 <= alike(texts[0], texts[1000]) < 0.85
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.near_dedup(df).collect()} == set(range(140))
    # Every pair that reaches 0.8 is among those of the prefix filter.
    sets = spark.createDataFrame([(i, sorted(map(hash, of_words(t)))) for i, t in rows], "node long, h array<long>")
    each = spark.createDataFrame([(i, i) for i, _ in rows], "node long, root long")
    assert {(k, 1000 + k) for k in range(0, 140, 4)} <= set(simhash._crowd_pairs(sets, each, 0.8).collect())


def test_components_of_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(1000, 1100)]
    hub = [(5, i) for i in range(2000, 2300)]
    edges = spark.createDataFrame([*chain, *hub, (7, 7), (8, 9), (9, 8), (8, 9)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 1000 for i in range(1000, 1101)}, **{i: 5 for i in [5, *range(2000, 2300)]}, 8: 8, 9: 8}
    assert components.components(edges.limit(0)).count() == 0


# --- benchmark -------------------------------------------------------------------------------


def test_decontamination_equals_brute_force(spark, none):
    items = [(k, words(n)) for k, n in enumerate((40, 30, 12, 7, 6))] + [(5, None), (6, ""), (0, None)]
    rows = []
    for k in range(60):
        text = words(120).split()
        if k % 2:
            passage = items[k % 5][1].split()
            for _ in range(k % 9):
                passage[rng.randrange(len(passage))] = "swapped"
            text[50:50] = passage[: 35 if k % 4 == 1 else None]
        rows.append((k, " ".join(text).upper() if k % 3 else "\n".join(text)))
    rows += [(60, None), (61, ""), (None, items[1][1]), (62, items[1][1] + " " + items[1][1])]

    want = {}
    for i, t in rows:
        w = (t or "").lower().split()
        for k, s in items:
            v = (s or "").lower().split()
            if len(v) < decontaminate.SPAN:
                continue
            wide = min(len(v), decontaminate.WINDOW)
            for d in range(-len(v), len(w)):
                eq = [0 <= d + j < len(w) and w[d + j] == v[j] for j in range(len(v))]
                best = max(sum(eq[s0 : s0 + wide]) for s0 in range(len(v) - wide + 1)) / wide
                if best >= decontaminate.LEAST:
                    want[i, k] = max(want.get((i, k), (0,)), (best, sum(eq), -d, len(v)))
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).unionByName(clashing(spark.createDataFrame(rows[:9], "doc_id long, text string")))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): (r.similarity, r.n_equal, -r["at"], r.n_words) for r in decontaminate.overlaps(docs, bench).collect()}
    assert len(got) >= 15 and got == want
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.overlaps(none, bench).count() == 0 and decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def test_every_accepted_pattern_holds_a_spaced_seed():
    for n in range(1, decontaminate.WINDOW + 1):
        need = -(-8 * n // 10)
        mask = decontaminate.MASKS[decontaminate.SEED_OF[n - 1]]
        sides = [(range(n),)] + [(range(c), range(c + 1, n)) for c in range(n)] + [(range(c), range(c, n)) for c in range(n + 1)]
        for parts in sides:
            # A dropped word is unequal as it is, an added one costs one more equal word.
            words_ = [j for part in parts for j in part]
            least = need + (len(parts) == 2 and len(words_) == n)
            for lost in range(max(-1, len(words_) - least) + 1):
                for other in combinations(words_, lost):
                    equal = [{j for j in part if j not in other} for part in parts]
                    assert any(all(s0 + o in e for o in mask) for e in equal for s0 in range(n)), (n, parts, other)
    assert sum(decontaminate.MASKS[decontaminate.SEED_OF[n - 1]][-1] >= len(decontaminate.MASKS[decontaminate.SEED_OF[n - 1]]) for n in range(6, 14)) == 8


def test_decontamination_of_quotes_gaps_and_short_items(spark):
    items = {k: [f"i{k}x{j}" for j in range(n)] for k, n in enumerate((39, 59, 15, 17, 25, 7, 6, 5, 4, 3, 2, 1))}
    around = lambda w: " ".join([*words(30).split(), *w, *words(30).split()])
    rows, want = [], set()

    def put(k, w, found):
        want.update({(len(rows), k)} if found else ())
        rows.append((len(rows), around(w)))

    for k, v in items.items():
        put(k, v, True)
        if len(v) >= 13:
            for c in range(len(v)):
                put(k, [*v[:c], "added", *v[c:]], True)
                put(k, v[:c] + v[c + 1 :], True)
            put(k, v[2:13], True)
            put(k, v[2:11], False)
        # Every pattern of substitutions that leaves the accepted share, and one more of each.
        wide = min(len(v), 13)
        for m in range(1, 4):
            for at in list(combinations(range(wide), m))[:: 7 if len(v) > 7 else 1]:
                quote = [f"other{j}" if j in at else x for j, x in enumerate(v[:wide])]
                put(k, quote, (wide - m) / wide >= 0.8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == want
    assert {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_decontamination_same_without_broadcast(spark, monkeypatch):
    text = words(40)
    docs = spark.createDataFrame([(1, "x y " + text), (2, words(50))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, text)], "item_id long, text string")
    small = table(decontaminate.overlaps(docs, bench), "doc_id", "item_id", "at", "n_equal")
    monkeypatch.setattr(decontaminate, "MAX_SEEDS", 0)
    monkeypatch.setattr(decontaminate, "MAX_DOCS", 0)
    assert table(decontaminate.overlaps(docs, bench), "doc_id", "item_id", "at", "n_equal") == small == [(1, 9, 2, 40)]


# --- vectors ---------------------------------------------------------------------------------


def test_vector_topk_equals_brute_force(spark):
    r = np.random.default_rng(4)
    vectors = [(i, r.normal(size=8).tolist()) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 420)]
    vectors += [(500, None), (550, []), (600, [1.0, None]), (650, [float("nan")] * 8), (700, [float("inf")] * 8), (None, [1.0] * 8), (800, [1.0, 2.0]), (801, [3.0, -1.0]), (7, vectors[7][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "d": F.lit(2), "rank": F.lit(3)})
    whole = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and np.isfinite(np.float32(x)) for x in v):
            whole[i] = np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)
    want = []
    for q, v in whole.items():
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in whole.items() if i != q and len(w) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    scaled = vector_topk.scaled(df)
    for rows, block in ((10**6, 10**6), (50, 3)):
        got = vector_topk.top_k(scaled, scaled.where("vec_id % 50 = 0"), slice_rows=rows, block_rows=block)
        assert table(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=str)
    assert vector_topk.top_k(scaled.limit(0), scaled.limit(0)).count() == 0


def test_vector_topk_of_repeated_rows(spark):
    r = np.random.default_rng(6)
    vectors = r.normal(size=(300, 8))
    copies = [(6 if i % 3 == 0 else 2) for i in range(300)]
    df = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(300) for _ in range(copies[i])], "vec_id long, embedding array<double>")
    whole = np.floor(256 * vectors).astype(np.int64)
    want = []
    for q in range(0, 300, 50):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(300) if i != q for _ in range(copies[i]))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    scaled = vector_topk.scaled(df)
    for rows in (10**6, 50):
        got = vector_topk.top_k(scaled, scaled.where("vec_id % 50 = 0"), slice_rows=rows)
        assert table(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=str)
    with duckdb.connect() as db:
        db.register("embeddings", df.toPandas())
        assert sorted(db.sql(queries_sql.ORACLE["op9_vector_topk"]).project("query_id, rank, vec_id, score").fetchall(), key=str) == sorted(want, key=str)


def test_vector_topk_of_large_components(spark):
    big = [(0, [1.0, 0.0]), (1, [2.0**41, 1.0]), (2, [2.0**45, -1.0]), (3, [-(2.0**50), 2.0**50]), (4, [0.5, 2.0**54])]
    top = lambda rows: table(vector_topk.top_k(vector_topk.scaled(d := spark.createDataFrame(rows, "vec_id long, embedding array<double>")), vector_topk.scaled(d).where("vec_id = 0"), k=3), "rank", "vec_id", "score")
    assert top(big) == [(1, 2, 2**61), (2, 1, 2**57), (3, 4, 2**15)]
    for bad in ([(0, [2.0**50, 0.0]), (1, [2.0**50, 0.0])], [(0, [1.0]), (1, [2.0**60])]):
        with pytest.raises(Exception, match="beyond 64 bits"):
            top(bad)


def test_approximation_prunes_most_vectors():
    r = np.random.default_rng(9)
    vectors = (r.normal(size=(2000, 16)) * 100).astype(np.int64)
    q, i, s = vector_topk.scan_slice(np.arange(2000), vectors, np.array([-1]), vectors[:1], 3)
    assert s.tolist() == sorted((vectors @ vectors[0]).tolist(), reverse=True)[:3] and i[0] == 0

    # The kth score is carried along: at 64 components few exact vectors are read.
    many, reads = (r.normal(size=(40_000, 64)) * 300).astype(np.int64), []
    q, i, s = vector_topk.scan_slice(np.arange(40_000), many, np.arange(20), many[:20], 5, reads=reads)
    for k in range(20):
        exact = many @ many[k]
        exact[k] = np.iinfo(np.int64).min
        assert s[q == k].tolist() == sorted(exact.tolist(), reverse=True)[:5]
    assert reads[0] < 0.1 * 20 * 40_000


# --- lines -----------------------------------------------------------------------------------


def test_line_spread(spark, docs, none):
    common, rare, short = "A line that every site carries.", "A line that few sites carry here.", "short"
    rows = []
    for k in range(60):
        body = [common if k % 5 else f"  {common}\t", rare if k < 4 else f"own line number {k} of this document", short]
        rows.append((k, "\n".join(body), "en", f"site{k % 12}", None))
    rows += [(60, None, "en", "site0", 1), (61, "", None, None, 1), (None, common, "en", "site1", 1), (1, rows[1][1], "en", "site1", None)]
    df = spark.createDataFrame(rows, DOCS)
    for margin in (0.15, 5.0):  # estimates decide, or everything is counted exactly
        out = line_spread.strip_lines(clashing(df), margin=margin)
        got = {(r.doc_id, r.text): (r.n_lines, r.n_removed) for r in out.collect()}
        assert got[(None, common)] == (1, 0)
        assert got[(0, f"{rare}\n{short}")] == (3, 1) and got[(30, f"own line number 30 of this document\n{short}")] == (3, 1)
        assert got[(60, None)] == (0, 0) and got[(61, "")] == (1, 0)
        assert out.count() == len(rows)
    assert line_spread.strip_lines(df, min_sites=13).where("n_removed > 0").count() == 0
    assert line_spread.strip_lines(clashing(docs)).count() == len(TEXTS)
    assert line_spread.strip_lines(none).count() == 0


# --- ranked lexical search -------------------------------------------------------------------


def ranked(docs, items):
    """Every document against every item, by the formulas."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, split(t)) for i, t in docs]
    bags = [(i, t, Counter(t)) for i, t in bags if t]
    n, total = len(bags), sum(len(t) for _, t, _ in bags)
    df = Counter(w for _, _, b in bags for w in b)
    out = []
    for item, text in set(items):
        scores = []
        for i, t, bag in bags:
            m = 75 + 25 * len(t) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * bag[w] // (1000 * bag[w] + 12 * m)) for w in split(text) if w in bag)
            scores += [(-s, -(2**63) if i is None else i, i)] if s > 0 else []
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:20], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "The same text"), (2, "abc; twice? TWICE! 2nd"), (3, None), (4, ""), (5, "nothing-known-here"), (None, "id text"), (6, "ünï 中文 ΣΑΣ é"), (1, "The same text"), (7, "two two two spaces")]


def test_bag_ranking(spark, docs):
    rows = TEXTS + [(100 + i, f"the {'same ' * (i % 3)}text") for i in range(60)] + [(None, "the same text")] * 3 + [(300 - i, "two spaces twice") for i in range(50)]
    table_ = clashing(spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit("x") for c in ("item", "rank", "doc", "n")})
    want = ranked(rows, ITEMS)
    for block in (2, bag_ranking.BLOCK):
        assert sorted(map(tuple, bag_ranking.rank_documents(table_, items, block).collect()), key=str) == want
    assert bag_ranking.rank_documents(table_.limit(0), items).count() == 0
    assert bag_ranking.rank_documents(table_, items.limit(0)).count() == 0


def test_bag_classes_are_verified_and_scored_in_stretches(spark, monkeypatch):
    """Equal hashes of different bags stay two classes; small stretches of classes give the same places."""
    rows = [(i, words(rng.randint(1, 30), "abc")) for i in range(400)]
    items = [(i, words(12, "abc")) for i in range(12)]
    want = ranked(rows, items)
    d, q = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(bag_ranking.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    assert sorted(map(tuple, bag_ranking.rank_documents(d, q).collect()), key=str) == want
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, t in items for w in bag_ranking.terms(t)}))}
    assert len(vocabulary) > 20
    asked = [np.unique([vocabulary[w] for w in bag_ranking.terms(t)], return_counts=True) for _, t in items]
    bags = [np.array(list(zip(*sorted(Counter(vocabulary[w] for w in bag_ranking.terms(t) if w in vocabulary).items()))) or [[], []], "<u4") for _, t in rows]
    held = [k for k, b in enumerate(bags) if b.size]
    batch = pa.RecordBatch.from_pydict({"class": held, "m": [100] * len(held), "bag": [bags[k].tobytes() for k in held], "first": held})
    class Held:  # noqa: E306
        def __init__(self, value):
            self.value = value
    weights = np.arange(1, len(vocabulary) + 1) * 100
    runs = []
    for cells in (1, 4_000_000):
        monkeypatch.setattr(bag_ranking, "CELLS", cells)
        runs.append(next(bag_ranking._score_classes(iter([batch]), Held(weights), Held(asked))).to_pydict())
    assert runs[0] == runs[1] and len(runs[0]["item"]) == 12 * 20


# --- personal data ---------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if "0" <= c <= "9"]
            doubled = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits[::-1]))
            sound = {"email": True, "ip": all(int(x) < 256 for x in m.group().split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if sound[kind]:
                yield f"{kind}:{m.start()}:{m.end()}"


def test_personal_data(spark, docs):
    odd = ["".join(rng.choices("a1 @.+-()5%_9,\n0Z4é😀", k=rng.randint(1, 150))) for _ in range(1500)]
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1112 4111111111111111", "6011000990139424000", "😀 5500005555555559, 1" + "0" * 17]
    places = ["1.2.3.4.5.6.7.8", "999.1.1.1 0255.01.1.1 256.1.1.1", "00000000000000000000.1.2.3", "a@b.c_d@e.f a@b@c.d", "x@y x@y. x@y.z.", "+1 (377) 555-0271 +12 +123456789012345678"]
    many = ["q.w@e.rt " * 700, "1.2.3.4 " * 513 + "é", "+49 30 1234567, " * 256]
    texts = [None, "", *odd, *cards, *places, *many, *(t for _, t in TEXTS)]
    frame = spark.createDataFrame([(i % 50 if i % 7 else None, i, t) for i, t in enumerate(texts)], "doc_id long, row long, text string").withColumns({c: F.lit("x") for c in ("spans", "t", "whole", "match_ip", "any")})
    got = {r.row: r for r in personal_data.find_spans(frame).collect()}
    assert len(got) == len(texts) and list(got[0].asDict()) == [*[c for c in frame.columns if c != "spans"], "spans"]
    for i, text in enumerate(texts):
        own = [f"{s.kind}:{s.start}:{s.end}" for s in got[i].spans if s.kind in personal_data.BASE]
        assert own == list(base_spans(text)), text
        assert all(0 <= s.score <= 100 for s in got[i].spans)
    digest = {r.spans: r for r in personal_data.span_digest(frame.where("row >= 1502")).collect()}
    for r in digest.values():
        base = [s for s in r.spans.split(",") if s.split(":")[0] in personal_data.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in base) for k in PLAIN]
    assert personal_data.span_digest(frame.limit(0)).count() == 0


def test_personal_data_by_checksum_and_context(spark):
    cases = {
        "DE89370400440532013000 BIC": ["iban:0:22"], "DE89370400440532013001": [], "xGB82 WEST 1234 5698 7654 32": [], "to GB82 WEST 1234 5698 7654 32.": ["iban:3:30"],
        "123-45-6789": [], "social security 123-45-6789": ["ssn:16:27"], "my SSN: 000-45-6789": [], "born 12/03/1980": ["birth:5:15"], "on 12/03/1980": [], "born 32/13/1980": [],
        "account 12345678": ["account:8:16"], "order 12345678 of account": [], "accountant 12345678": [],
    }
    got = {r.text: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind not in personal_data.BASE] for r in personal_data.find_spans(spark.createDataFrame([(t,) for t in cases], "text string")).collect()}
    assert got == cases
    scores = {r.text: r.spans[0].score for r in personal_data.find_spans(spark.createDataFrame([(t,) for t in ("host 1.2.3.4", "version 1.2.3.4", "1.2.3.4")], "text string")).collect()}
    assert scores["host 1.2.3.4"] > scores["1.2.3.4"] > scores["version 1.2.3.4"]


def test_personal_data_in_very_long_runs(spark):
    """Runs on which the plain patterns take quadratic time or run out of stack."""
    runs = ["1" * 200_000, "a" * 200_000, "a@" * 50_000, "1-" * 100_000, "+1" + " (" * 50_000, "1." * 50_000 + "x", "0" * 100_000 + ".1.1.1"]
    got = {r.n: r.spans for r in personal_data.span_digest(spark.createDataFrame([(i, t) for i, t in enumerate(runs)], "doc_id long, text string")).selectExpr("doc_id n", "spans").collect()}
    assert [got[i].count("email") for i in range(7)] == [0] * 7 and got[5].count("ip:") == 12_500 and got[6] == "ip:0:100006"


def test_personal_data_stays_in_the_jvm(spark, docs):
    plan = personal_data.span_digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- collocations ----------------------------------------------------------------------------


def mined(rows, least, top, explained=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for p, a in candidates.items():
        lang, w = p[0], p[1:]
        if any(q[0] == lang and len(q) > len(p) and 100 * b >= explained * a and any(q[i : i + len(w)] == w for i in range(1, len(q))) for q, b in candidates.items()):
            continue
        score, cut = min((2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[(lang, *w[:cut])], f[(lang, *w[cut:])], n[lang]))
    got, ranks = [], Counter()
    for lang, score, a, phrase, left, right, total in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            got.append((lang, ranks[lang], phrase.decode(), -a, left, right, total, -score))
    return sorted(got, key=str)


def phrase_rows():
    some = ["red", "Green", "blue", "the", "of", "ünï", "中", "x.y", "a!b", " q"]
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choices(some, k=rng.randint(0, 25)))) for _ in range(300)]
    long_passage = words(70, "klmnop")
    rows += [("en", f"{words(3)} {long_passage} {words(2)}") for _ in range(8)] + [("en", long_passage)] * 2 + [("en", "go go go go go go")] * 4
    rows += [("en", None), ("en", ""), ("de", " \t. ,"), ("und", "red green"), ("", "red blue red blue red blue"), ("en", "la " * 500), ("en", "one\x0btwo\x0cone\x1ctwo\x00three")]
    return rows + [("de", "tail\tof the\t tail")] * 5


@pytest.mark.parametrize("bits", [collocations.LINK_BITS, 6])
def test_collocations(spark, bits):
    """Equal to a count of all phrases, with a sparse link table and with a full one."""
    rows = phrase_rows()
    frame = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("x") for c in ("phrase", "n", "k", "score", "rank", "path", "doc_id")}).repartition(5)
    for least, top in ((4, 2000), (9, 7)):
        assert sorted(map(tuple, collocations.collocations(frame, least, top, bits=bits).collect()), key=str) == mined(rows, least, top)
    assert collocations.collocations(frame.limit(0), 4, bits=bits).count() == 0


def test_collocation_counts_and_paths(spark):
    rows = phrase_rows()
    frame = spark.createDataFrame(rows, "lang string, text string")
    table_ = collocations.edges(frame, collocations.frequent_links(frame, 4, 16), 16).cache()
    at = collocations.nodes(table_).cache()
    paths = collocations.unary_paths(table_, at, 4).collect()
    # The repeated passage of 70 words is one path; no node inside a path branches.
    assert max(len(p.path.split(" ")) for p in paths) >= 70 and any(p.n == 10 and len(p.path.split(" ")) == 70 for p in paths)
    through = {(r.lang, r.phrase) for r in at.where("passes").collect()}
    inner = [(p.lang, " ".join(w[i : i + 3])) for p in paths for w in [p.path.split(" ")] for i in range(1, len(w) - 3)]
    assert len(inner) == len(set(inner)) and set(inner) <= through
    counted = Counter()
    for lang, text in rows:
        for piece in b" ".join(collocations.tokens(text)).decode().split("."):
            w = [x for x in piece.split(" ") if x]
            counted.update(("und" if lang is None else lang, " ".join(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    counts, total = collocations.phrase_counts(frame, 4)
    assert {(r.lang, r.phrase): r.f for r in counts.collect()} == {p: c for p, c in counted.items() if c >= 4}
    assert counts.count() == counts.select("lang", "phrase").distinct().count()


def test_collocations_broadcast_no_table_of_unknown_size(spark, monkeypatch):
    """Small files that an explode makes large stay below Spark's threshold; only the totals, one row a language, may be broadcast."""
    rows = phrase_rows()
    frame = spark.createDataFrame(rows, "lang string, text string")
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(collocations, "stored", lambda df, name: plans.append(plan(df)) or common.stored(df, name))
    monkeypatch.setattr("lexgrove.scale.MAX_DIM_ROWS", 3)
    found = collocations.collocations(frame, 4)
    assert sum("Generate" in p for p in plans) and sum("SortMergeJoin" in p for p in plans) > 3
    assert not [p for p in plans if "Broadcast" in p]
    assert plan(found).count("BroadcastExchange") <= 1 and plan(found).count("SortMergeJoin") >= 3
    assert sorted(map(tuple, found.collect()), key=str) == mined(rows, 4, 2000)


# --- rows that share an id, very long URLs ---------------------------------------------------


def test_of_fully_repeated_rows_one_stays(spark):
    text, other = words(60, "abcdefgh"), words(60, "ijklmnop")
    rows = [(5, text, "en", "s", 1), (5, text, "en", "s", 1), (5, text, "de", "s", 1), (None, other, "en", "s", 1), (None, other, "en", "s", 1), (None, words(60, "qrstuvw"), "en", "s", 1), (7, None, "en", "s", 1)]
    got = simhash.near_dedup(clashing(spark.createDataFrame(rows, DOCS)))
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id) == [(5, text), (7, None)]
    assert got.where("doc_id is null").count() == 2


def test_clean_texts_under_a_contaminated_id_stay(spark):
    item, clean = words(20, "abcdefgh"), words(40, "ijklmnop")
    rows = [(None, f"x {item} y"), (None, clean), (3, item), (3, clean), (4, clean)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.clean_documents(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(None, clean), (3, clean), (4, clean)], key=str)


def test_very_long_urls(spark):
    keys = spark.createDataFrame([("com/", url_filter.BLOCK), ("a.b.com/x/", url_filter.ALLOW)], "key string, kind int")
    urls = {"http://a.b.com/x/" + "y/" * 200_000: "allow", "http://" + "a." * 200_000 + "com/" + "z/" * 100_000: "block", "http://a.b.com/xx/": "block", "http://" + "a/" * 100_000: "allow"}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, url_filter.build_digests(keys)).select("page_id", "verdict").collect()}
    assert [got[i] for i in range(4)] == list(urls.values())
    assert url_filter.probes("a.b.com", "/x/y/", 10) == ["a.b.com/", "a.b.com/x/", "com/", "com/x/", "com/x/y/", "b.com/", "b.com/x/", "b.com/x/y/"]
