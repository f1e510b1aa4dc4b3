"""Operators 3, 4, 5, 8 and 10 against brute force, and their edge cases."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import lower, make, words_of
from textbench.llm import byte_bpe, common, language_model, minhash, substring_dedup, token_files

tokenizers_data = pytest.importorskip("public_tokenizers")


# ------------------------------------------------------------------ words

@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abé中 \n\t\x0b ", max_size=12), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    import pyarrow as pa
    w = common.Words(*common.text_bytes(pa.array(texts, pa.string())))
    raw = w.data.tobytes()
    found = [raw[a:b].decode() for a, b in zip(w.starts, w.ends)]
    assert found == [x for t in texts for x in words_of(t)]
    assert w.counts.tolist() == [len(words_of(t)) for t in texts]
    h = w.hashes()
    assert all((h[i] == h[j]) == (found[i] == found[j]) for i in range(len(h)) for j in range(i))


def test_blocks_send_rows_in_proportion_to_the_input(monkeypatch):
    size = 4 << 20
    assert [common.asking_blocks(n * size, size) for n in (0, 1, 8, 64, 512)] == [1, 1, 8, 64, 512]
    rows = [common.asking_blocks(n * size, size) ** 2 / n for n in (512, 5120, 51200, 25 * 10**6)]
    assert max(rows) <= 512 and min(rows) > 500
    monkeypatch.setattr(common, "SPREAD", 8)
    assert [common.asking_blocks(n, 1) ** 2 for n in (8, 32, 128, 512)] == [64, 256, 1024, 4096]


def test_blocks_beyond_the_spread_and_partitions_of_many_blocks(docs, monkeypatch):
    """The same results with grown blocks, and with several blocks in a partition."""
    figures = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    want = figures(substring_dedup.remove_repeated(docs, 50, 3000))
    monkeypatch.setattr(common, "SPREAD", 4)
    monkeypatch.setattr(common, "MOST_PARTITIONS", 3)
    assert figures(substring_dedup.remove_repeated(docs, 50, 3000)) == want
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
           for r in minhash.near_duplicates(docs).collect()}
    assert got == _components([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_rows_without_an_id_go_to_many_blocks(spark):
    from pyspark.sql import functions as F
    texts = [f"text number {i} " * 20 for i in range(200)]
    d = make(spark, texts).withColumn("doc_id", F.lit(None).cast("long"))
    got = substring_dedup.remove_repeated(d, 50, 2000)
    assert sorted(r["kept_text"] for r in got.collect()) == sorted(t.strip() for t in texts)
    assert got.groupBy(F.spark_partition_id()).count().count() > 3
    scored = language_model.score_documents(d, block_bytes=2000).collect()
    assert len(scored) == 200 and len({r["score"] for r in scored}) > 1


# ------------------------------------------------------------------ 3

def _components(rows, percent=85):
    sets = {}
    for i, text in rows:
        w = [lower(x) for x in words_of(text)]
        grams = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        sets[i] = grams
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def _chain(n=25, length=120, step=3):
    """Each text shares most shingles with the next one: one long component."""
    words = [f"c{i}" for i in range(length + n * step)]
    return [" ".join(words[i * step:i * step + length]) for i in range(n)]


def test_near_duplicates_against_brute_force(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
           for r in minhash.near_duplicates(docs).collect()}
    assert got == _components([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_near_duplicate_chains_and_chunks(spark):
    r = np.random.default_rng(3)
    texts = _chain() + _chain(n=3, length=12, step=5)
    base = [f"g{i}" for i in range(200)]
    for k in range(40):
        copy = list(base)
        for place in r.integers(0, 200, k % 9):
            copy[place] = f"n{k}.{place}"
        texts.append(" ".join(copy))
    ids = [int(x) for x in r.permutation(len(texts)) * 7]
    d = make(spark, texts, ids)
    want = _components(list(zip(ids, texts)))
    for chunk in (4, 256):  # groups above a chunk are dealt into several tasks
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"])
               for r in minhash.near_duplicates(d, chunk=chunk).collect()}
        assert got == want


def test_near_duplicates_edges(odd, empty):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(odd).collect()}
    assert set(got) == {1, 2, 3, 5} and got[3]["n_shingles"] == 0
    left = minhash.keep_one(odd)
    assert left.columns == odd.columns and left.where("doc_id IS NULL").count() == 2
    assert minhash.near_duplicates(empty).count() == minhash.keep_one(empty).count() == 0


# ------------------------------------------------------------------ 4

@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(tokenizers_data.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def tiktoken_encoding(ranks):
    import tiktoken
    return tiktoken.Encoding("own", pat_str=tokenizers_data.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark, docs, ranks, tiktoken_encoding):
    hard = ["a" * 200 + " " * 100 + "x\n\n  y 　 z \U0001d4b3 ñ́ " + "é" * 50 + " it's we'll 12345 ...!!!",
            "<|endoftext|> \x00\x1c   ", "中文" * 40, "\U0001f600" * 30, "aaaaaaaaab" * 30]
    d = docs.unionByName(make(spark, hard, [1000 + i for i in range(len(hard))]))
    decoded = byte_bpe.decode(byte_bpe.encode(d, ranks, tokenizers_data.PATTERN), ranks).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    assert len(decoded) == len(texts)
    for r in decoded:
        ids = np.frombuffer(r["raw"], "<u4").tolist()
        assert ids == tiktoken_encoding.encode_ordinary(texts[r["doc_id"]]) and len(ids) == r["n_tokens"]
        assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]


def test_bpe_looks_pieces_up_once_for_a_block(ranks, monkeypatch):
    """The table of a block's pieces is built once, not for each of its packs."""
    import pyarrow as pa
    texts = [[f"w{i * k % 97}" for k in range(20)] + [" é", "中"] for i in range(60)]
    batches = [pa.RecordBatch.from_pydict({
        "block": pa.array([0] * 3, pa.int32()), "doc_id": pa.array(range(i, i + 3), pa.int64()),
        "pieces": pa.array(texts[i:i + 3], pa.list_(pa.string()))}) for i in range(0, 60, 3)]
    table = pa.Table.from_batches([pack for b in batches for pack in byte_bpe._pack_documents([b])])
    assert table.num_rows == 20
    named = byte_bpe._name(4)(table)
    asked = pa.Table.from_batches([pa.RecordBatch.from_arrays([named[c].combine_chunks() for c in named.column_names],
                                                              named.column_names)])
    answers = []
    for bucket in sorted(set(asked["bucket"].to_pylist())):
        rows = byte_bpe._questions(asked.filter(pa.compute.equal(asked["bucket"], bucket)))
        ids = pa.array([[byte_bpe.merge(p.encode(), ranks) for p in x] for x in rows["pieces"].to_pylist()],
                       pa.list_(pa.list_(pa.int32())))
        answers += byte_bpe._answers(ranks)(rows.append_column("ids", ids).to_batches())
    lookups = []

    class Counted:
        def __getattr__(self, name):
            if name in ("index_in", "dictionary_encode", "unique"):
                lookups.append(name)
            return getattr(pa.compute, name)
    monkeypatch.setattr(byte_bpe, "pc", Counted())
    out = byte_bpe._replace(4, lambda batch: batch)(table, pa.Table.from_batches(answers))
    assert len(lookups) == 1  # 21 when each of 20 packs had a lookup of its own
    got = dict(zip(out["doc_id"].to_pylist(), out["ids"].to_pylist()))
    assert got == {i: [r for p in t for r in byte_bpe.merge(p.encode(), ranks)] for i, t in enumerate(texts)}


def test_bpe_fold_is_the_merge(spark, ranks):
    from pyspark.sql import functions as F
    r = np.random.default_rng(4)
    pieces = ["".join(r.choice(list("abestring 0é中\u00ff"), n)) for n in [*range(1, 40), 61, 62] for _ in range(3)]
    pieces = [p for p in pieces if len(p.encode()) <= 62]
    row = spark.createDataFrame([(pieces,)], "pieces array<string>")
    with byte_bpe._short_plans(spark):
        got = row.select(F.expr(byte_bpe.fold_sql(ranks)).alias("ids")).first()["ids"]
    assert got == [byte_bpe.merge(p.encode(), ranks) for p in pieces]


def test_bpe_blocks_and_edges(docs, odd, empty, ranks):
    one = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(docs, ranks, tokenizers_data.PATTERN).collect()}
    many = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(docs, ranks, tokenizers_data.PATTERN, 3000).collect()}
    assert one == many
    assert byte_bpe.round_trip(odd).count() == odd.count()
    assert byte_bpe.round_trip(empty).count() == 0


def test_a_task_packs_for_few_blocks(spark, ranks, monkeypatch):
    """Blocks are shares of the partitions: not a pack for every block in each task."""
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(words[(i * 7 + k * k) % 300] for k in range(60)) for i in range(200)] + [None, "", "one id twice"]
    d = make(spark, texts, [*range(200), None, 200, 200]).repartitionByRange(5, "n_chars")
    dealt, real = [], byte_bpe.dealt_by
    monkeypatch.setattr(byte_bpe, "dealt_by", lambda df, key, n: dealt.append((key, n, df)) or real(df, key, n))
    got = byte_bpe.encode(d, ranks, tokenizers_data.PATTERN, 2000).collect()
    key, blocks, packs = dealt[0]
    assert key == "block" and blocks > 30
    assert packs.count() <= blocks + 5
    assert packs.select("block").distinct().count() > blocks // 2
    assert len(got) == len(texts)
    monkeypatch.undo()
    whole = byte_bpe.encode(d, ranks, tokenizers_data.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(r["doc_id"]), r["ids"]) for r in whole)


def test_bpe_batches_of_long_texts_are_small(spark, ranks, monkeypatch):
    """Batches are cut by their bytes: ten thousand long texts at once are held outside
    Spark's heap and by its Python worker."""
    real, name = byte_bpe._pack_documents, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def pack(batches):
        def seen():
            for batch in batches:
                assert batch.nbytes < 3 * (4 << 20), batch.nbytes
                yield batch
        yield from real(seen())
    monkeypatch.setattr(byte_bpe, "_pack_documents", pack)
    d = make(spark, [f"{i} " + "word " * 2000 for i in range(1000)], range(1000)).coalesce(1)
    got = byte_bpe.encode(d, ranks, tokenizers_data.PATTERN)
    assert {r["doc_id"]: len(r["ids"]) for r in got.collect()} == {
        i: len(byte_bpe.merge(str(i).encode(), ranks)) + 2001 for i in range(1000)}
    assert spark.conf.get(name) == before


def test_bpe_lists_are_joined_in_slices(ranks):
    """Decoding holds a few bytes for each byte of text, not three long numbers."""
    import tracemalloc

    import pyarrow as pa
    ids = [i % 50000 for i in range(1_000_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()),
                                        "ids": pa.array([ids[:400_000], ids[400_000:]], pa.list_(pa.int32()))})
    decode = byte_bpe._decoder(ranks)
    tracemalloc.start()
    out = decode(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    by_id = {rank: token for token, rank in ranks.items()}
    got = out["decoded"].to_pylist()
    assert got == [b"".join(by_id[i] for i in own) for own in (ids[:400_000], ids[400_000:])]
    assert peak < 8 * sum(map(len, got))


def test_bpe_block_lookup_needs_no_python_worker(spark):
    """Sizes of partitions are rows of the plan: read as Python objects, they start workers
    of their own on the executors."""
    rows, _ = byte_bpe.in_blocks(make(spark, ["a b", "c"], [1, 2]), 1)
    assert "LocalTableScan" in rows._jdf.queryExecution().toString().split("Physical Plan")[1].split("BroadcastExchange")[-1]


# ------------------------------------------------------------------ 5

@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=70))
def test_codes_decode_to_the_same_values(values):
    control, data = token_files.encode_ranks(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert token_files.decode_ranks(control, data, len(values)).tolist() == values


def test_token_files(spark, docs, monkeypatch):
    from tokenizers import Tokenizer
    path = tokenizers_data.path("word_bpe_49k.json")
    hard = ["Ab<|endoftext|>x  ÉÀ é 　 q\x1cz ΣΑΣ it's 12,3", "́ starts with a mark"]
    d = docs.unionByName(make(spark, hard, [-5, 10**12])).repartition(5)
    monkeypatch.setattr(token_files, "SEGMENT_BYTES", 4000)
    monkeypatch.setattr(token_files, "SHARD_BYTES", 20000)
    folder = common.shared_path(spark, "test-tokens")
    token_files.write_token_files(d, folder, path)
    got = {r["doc_id"]: (r["start"], list(r["ids"])) for r in token_files.read_token_files(spark, folder).collect()}
    tokenizer, start = Tokenizer.from_file(path), 0
    for r in sorted(d.collect(), key=lambda r: r["doc_id"]):
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        assert got[r["doc_id"]] == (start, ids)
        start += len(ids)
    assert spark.read.parquet(f"{folder}/tokens").count() > 5


def test_token_files_are_summed_up_where_they_are_read(spark, docs, scratch):
    """Ids do not travel from a task to Spark and back for what is made of them."""
    path, folder = tokenizers_data.path("word_bpe_49k.json"), f"{scratch}/token-files-once"
    token_files.write_token_files(docs, folder, path)
    got = token_files.read_token_files(spark, folder, token_files._checksums,
                                       "doc_id long, start long, n_tokens long, ids_crc32 long")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # 2 before
    want = sorted((r["doc_id"], r["start"], len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
                  for r in token_files.read_token_files(spark, folder).collect())
    assert sorted(map(tuple, got.collect())) == want


def test_token_files_trailing_punctuation():
    import pyarrow as pa
    texts = ["a. b.. c... d.... e..... f...... . .. é. é.. x?!; 12:", "", "?", "a.b. (c)."]
    words = common.Words(*common.text_bytes(pa.array(texts)))
    starts, ends, first = token_files._units(words, common.LOWER[words.data])
    raw = words.data.tobytes()
    units = [raw[a:b].decode() for a, b in zip(starts, ends)]
    want, firsts = [], []
    for word in [raw[a:b] for a, b in zip(words.starts, words.ends)]:
        end = len(word)
        for _ in range(4):
            end -= end > 1 and word[end - 1] in b".,;:!?"
        cut = end < len(word) and chr(word[end - 1]) in "abcdefghijklmnopqrstuvwxyz0123456789"
        firsts.append(len(want))
        want += [word[:end].decode(), word[end:].decode()] if cut else [word.decode()]
    assert units == want and first.tolist() == [*firsts, len(want)]


def test_token_files_edges(spark, odd, empty):
    path = tokenizers_data.path("word_bpe_49k.json")
    for d in (odd, empty):
        folder = common.shared_path(spark, "test-tokens")
        token_files.write_token_files(d, folder, path)
        out = token_files.read_token_files(spark, folder).collect()
        assert len(out) == d.count()
        assert sorted(r["start"] for r in out)[:1] == [0][:len(out)]


# ------------------------------------------------------------------ 8

def _held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_language_model_base_and_gain(spark):
    r = np.random.default_rng(5)
    languages = [[f"{p}{k}" for k in range(60)] for p in ("a", "b")]
    texts = [" ".join(r.choice(languages[i % 2], 60)) for i in range(400)] + [None, "", "Never seen é words"]
    d = make(spark, texts)
    got = {x["doc_id"]: x for x in language_model.score_documents(d, block_bytes=20000).collect()}
    rows = {i: [lower(w) for w in words_of(t)] + ["</end>"] for i, t in enumerate(texts)}
    count = collections.Counter(w for i, ws in rows.items() if not _held_out(i) for w in ws)
    total, types = sum(count.values()), len(count)
    base = score = 0
    for i, ws in rows.items():
        g = got[i]
        want = sum(math.log10((count[w] + 1) / (total + types + 1)) for w in ws)
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (
            _held_out(i), len(ws), sum(count[w] > 0 for w in ws), total)
        assert abs(g["base_score"] - want) < 1e-6 * max(1, abs(want))
        if g["held_out"]:
            base, score = base + g["base_score"], score + g["score"]
    assert score > base + 0.03 * sum(_held_out(i) for i in rows) * 60  # the word before tells the language


def test_language_model_probabilities_sum_to_one(spark):
    texts = ["one two three two one two"] * 3 + ["four five"]
    d = make(spark, texts)
    counted = _counted(spark, d)
    v = language_model.Vocabulary(counted)
    model = language_model.train(d, v, 1)
    names = np.arange(1, 257, dtype=np.uint64) * np.uint64(64)
    features = language_model._features(names[:4], np.array([0, 4]))
    (_, a, _), _ = model._factors(features, np.zeros(4, int))
    assert np.allclose(a.sum(1), 1, atol=1e-5)
    total = 0.0
    for cell in range(256):
        (_, a, x), (_, b, y) = model._factors(features[:, :1], np.array([cell]))
        total += float(a[0, x[0]] * b[0, y[0]])
    assert abs(total - 1) < 1e-4


def _counted(spark, d):
    from pyspark.sql import functions as F
    dealt = d.select("doc_id", "text", language_model.held_out().alias("held_out"), F.lit(0).alias("block"))
    sent = dealt.groupBy("block").applyInArrow(language_model._send(1), "bucket int, block int, names binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(
        language_model._total, "block int, bucket int, counts binary, types array<long>, tokens array<long>, "
                               "top array<long>, top_counts array<long>")


def test_language_model_hashes_a_block_in_slices(monkeypatch):
    """A block's task needs little beyond its text; slices change no name."""
    import tracemalloc

    import pyarrow as pa
    texts = [" ".join(f"Word{i * k % 977}" for k in range(300)) for i in range(2000)] + [None, ""]
    table = pa.table({"text": pa.array(texts, pa.string())})
    size = sum(len(t or "") for t in texts)
    tracemalloc.start()
    names, bounds = language_model._tokens(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * size, peak / size  # 39 bytes a byte of text when hashed whole
    monkeypatch.setattr(common.pieces, "__defaults__", ("text", 1 << 30))
    whole = language_model._tokens(table)
    assert (names == whole[0]).all() and (bounds == whole[1]).all()
    assert [len(x) for x in language_model._tokens(table.slice(0, 0))] == [0, 1]


def test_language_model_edges(odd, empty):
    out = language_model.score_documents(odd).collect()
    assert len(out) == odd.count() and all(math.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in out)
    assert language_model.score_documents(empty).count() == 0


# ------------------------------------------------------------------ 10

def _removed(rows, window):
    first, words = {}, [(i, words_of(t)) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - window + 1):
            k = tuple(w[j:j + window])
            first[k] = min(first.get(k, i), i)
    out = collections.defaultdict(list)
    for i, w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < i:
                gone.update(range(j, j + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i].append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("window, block_bytes", [(50, 1 << 20), (50, 3000), (5, 3000)])
def test_substring_dedup_against_brute_force(docs, window, block_bytes):
    got = collections.defaultdict(list)
    for r in substring_dedup.remove_repeated(docs, window, block_bytes).collect():
        kept = r["kept_text"]
        got[r["doc_id"]].append((r["n_words"], r["n_removed"], hashlib.sha256(kept.encode()).hexdigest()))
        assert sum(b - a for a, b in zip(r["starts"], r["ends"])) == r["n_removed"]
        assert all(b < a for b, a in zip(r["ends"], r["starts"][1:]))  # maximal intervals
    want = _removed([(r["doc_id"], r["text"]) for r in docs.collect()], window)
    assert got == want and any(v[0][1] for v in want.values())


def test_substring_dedup_edges(odd, empty):
    rows = substring_dedup.remove_repeated(odd, 5).collect()
    assert len(rows) == odd.count()
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] in (None, 1))
    assert substring_dedup.remove_repeated(empty).count() == 0


# ------------------------------------------------------------------ 5, spelling of special tokens

@pytest.mark.parametrize("order", [1, -1])
def test_special_tokens_count_as_they_are_spelled(spark, order):
    import pyarrow as pa
    path = tokenizers_data.path("word_bpe_49k.json")
    texts = ["a <|ENDOFTEXT|> b", "a <|endoftext|> b", "x<|endoftext|>y.", "X<|EndOfText|>Y!", "<|startoftext|>", "a<b A<B",
             "ÀÉÎ Straße İstanbul ΑΣ σς ǅ ﬁ ſtop Ĳ don't naïve é", "<", None, "plain Words, here."][::order]
    whole = token_files._tokenizer(path)
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    known = token_files.WordIds(path)
    for chunk in (texts, texts[::-1]):  # words remembered from one call to the next
        ids, bounds = token_files.tokenize(pa.array(chunk, pa.string()), known, 2)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == (want if chunk is texts else want[::-1])
    for parts in (1, 4):
        d = make(spark, texts).repartition(parts)
        got = {r["doc_id"]: token_files._from_planes(r["ids"]).tolist() for r in token_files.tokenized(d, path).collect()}
        assert got == dict(enumerate(want))


def test_words_are_encoded_once_whatever_follows_them():
    """Punctuation of any kind after a Latin letter is cut off, and the ids are the library's."""
    import pyarrow as pa
    path = tokenizers_data.path("word_bpe_49k.json")
    whole = token_files._tokenizer(path)
    words = ["retion", "sch\u00fc\u00e4", "\u017dlu\u0165", "A1", "don't", "x\u00d7", "\u0130", "e\u0301", "a|", "<b", "</w", "\u4e2d"]
    tails = [",***", "###", "%%%", "'", "&&&", ".'", ")", "_", "-", "\"]", ">", "|>", "<", "'s", "!!!!!!", "\\", "~`", "$^"]
    texts = [" ".join(w + t for w in words) for t in tails] + [" ".join(words), "a<|endoftext|> b<|endoftext|>, x'.' it's' "]
    known = token_files.WordIds(path)
    ids, bounds = token_files.tokenize(pa.array(texts), known, 2)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [
        [*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    known = token_files.WordIds(path)
    token_files.tokenize(pa.array([" ".join(w + t for w in words[:4] for t in tails[:10])]), known, 2)
    assert len(known.hashes) == 14  # 40 before


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abZ09\u00e9\u00dc\u0130\u017f\u4e2d\u0301'.,!*&#%$|<>-_\"()\u00a0 \n", max_size=16), max_size=6))
def test_token_ids_are_the_librarys(texts):
    import pyarrow as pa
    path = tokenizers_data.path("word_bpe_49k.json")
    ids, bounds = token_files.tokenize(pa.array(texts, pa.string()), token_files.WordIds(path), 2)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [
        [*token_files._tokenizer(path).encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_words_are_kept_from_one_task_to_the_next(scratch):
    import os
    import shutil
    import pyarrow as pa
    path = shutil.copy(tokenizers_data.path("word_bpe_49k.json"), scratch)
    held = lambda job="a": token_files.WordIds(path, held=token_files._words_of(path, job))
    token_files.tokenize(pa.array(["some words, some more"]), held(), 2)
    again = held()
    again._encode = None  # nothing is new
    got = token_files.tokenize(pa.array(["more words some,"]), again, 2)[0].tolist()
    assert got == [*token_files._tokenizer(path).encode("more words some,").ids, 2]
    assert len(held().hashes) and not len(token_files.WordIds(path).hashes)
    os.utime(path, (1, 1))  # another file: nothing of the old one is used
    assert not len(held().hashes)
    token_files.tokenize(pa.array(["words"]), held(), 2)
    assert len(held().hashes) and not len(held("b").hashes) and not len(held().hashes)  # nor of another job


# ------------------------------------------------------------------ 4, pieces of any length

def test_long_pieces_take_no_quadratic_time(spark, ranks):
    import time

    import tiktoken
    library = tiktoken.Encoding("own", pat_str=tokenizers_data.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = np.random.default_rng(5)
    letters = "".join(r.choice(list("abcdefghijklmnopqrstuvwxyzéß中文字の"), 20_000))
    long = ["x" * 5000, letters, "的是不我一有大在人了中到資要可以這個你會好為上來學就交也用能如時文說沒他看那問生過下請天們所多麼小之" * 300]
    start = time.time()
    own = [byte_bpe.merge(t.encode(), ranks) for t in long]
    assert time.time() - start < 2
    assert own == [library.encode_ordinary(t) for t in long]
    for k in range(300):
        t = "".join(r.choice(list("aabbc中é"), r.integers(1, 80)))
        assert byte_bpe.merge(t.encode(), ranks) == library._core_bpe.encode_single_piece(t.encode())
    d = make(spark, [*long, "a" * 62, "b" * 63, "ab" * 31, "z" * 200_000, None, ""], [1, 1, None, None, 3, 4, 5, 6, 7])
    got = sorted((str(x["doc_id"]), x["ids"]) for x in byte_bpe.encode(d, ranks, tokenizers_data.PATTERN, 50_000).collect())
    want = sorted((str(x["doc_id"]), library.encode_ordinary((x["text"] or "")[:0 if x["doc_id"] == 5 else None]))
                  for x in d.collect() if x["doc_id"] != 5)
    assert [g for g in got if g[0] != "5"] == want
    z = [g for g in got if g[0] == "5"][0][1]
    token = {v: k for k, v in ranks.items()}
    assert b"".join(token[i] for i in z) == b"z" * 200_000
    # the session's settings are as before
    assert spark.conf.get("spark.sql.maxPlanStringLength") == spark.newSession().conf.get("spark.sql.maxPlanStringLength")
