"""The training-data operators against brute force, round trips, held-out accuracy and odd inputs."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from common import DATA, duck, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from voxmere.llm import decontam, langid, linededup, neardup, packing, quality, queries, repeats, sharding, toxicity, webp

SF = f"{DATA}/sf0.001"
DOCS = "doc_id long, text string, extra string, key string, score double, shard int, size string, bucket int"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeats, a very long text, and columns with names that operators use themselves."""
    long_text = " ".join(f"word{i % 5000}" for i in range(60_000))
    values = [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "same text here is repeated word for word"), (6, "same text here is repeated word for word"), (7, long_text), (8, long_text + " end"), (9, "í í í í"), (10, "\x00�🙂 emoji")]
    return spark.createDataFrame([(i, t, None, "k", 1.5, 7, None, 3) for i, t in values], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- MinHash ------------------------------------------------------------------------------------------------


def brute_near(texts: dict, k: int, percent: int) -> dict:
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates_brute_force(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op8_near_duplicates"](spark, SF).collect()}
    assert got == brute_near(texts, 3, 85)


def test_near_duplicates_chain_of_edits(spark):
    """A chain whose neighbours are linked and whose ends are not; many members share buckets."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        rows.append((i, " ".join(words)))
        words[int(rng.integers(0, 120))] = f"x{i}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.key: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, size=3, percent=85).collect()}
    assert got == brute_near(dict(rows), 3, 85)


def test_estimate_is_collision_corrected():
    rng = np.random.default_rng(0)
    shared, a, b = (rng.integers(0, 1 << 62, n, dtype=np.uint64) for n in (800, 100, 100))
    row = np.zeros(900, np.int64)
    sig = [neardup.packed(neardup.minima(row, np.concatenate([shared, x]))[1]).view(np.uint64)[0] for x in (a, b)]
    differ = np.zeros(2, np.uint64)
    for p in range(neardup.BITS):
        differ |= sig[0][2 * p : 2 * p + 2] ^ sig[1][2 * p : 2 * p + 2]
    agree = 1 - np.bitwise_count(differ).sum() / neardup.HASHES
    assert abs((agree - 1 / 16) / (1 - 1 / 16) - 0.8) < 0.15


def test_near_duplicates_odd_inputs(spark, odd, empty):
    got = {r.key: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(odd).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (1, 4)
    assert got[6][1] == 5 and got[8][1] == 7
    assert neardup.near_duplicates(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("ab1@!.lli", min_size=1, max_size=9), st.integers(0, 5))
def test_restoring_is_the_best_of_all_paths(word, seed):
    gain = (np.random.default_rng(seed).standard_normal((28, 28, 28)) * 2).tolist()
    every = {x: s for s, x in _all_readings(word, gain)}
    assert every[toxicity.restore(word, gain)] == pytest.approx(max(every.values()))


def _all_readings(word, gain):
    """Every string of letters that a path through the lattice reads, with its best score."""
    import itertools

    found = {}
    for keep in itertools.product((0, 1, 2), repeat=len(word)):
        letters, score, a, b, fits = "", 0.0, 0, 0, True
        for i, (c, k) in enumerate(zip(word, keep)):
            if c.isalpha():
                run = 1 + sum(all(0 <= j < len(word) and word[j] == c for j in js) for js in ([i - 1], [i + 1], [i - 1, i - 2], [i + 1, i + 2]))
                if k == 0:
                    x, cost = c, 0.0
                elif k == 1 and i and word[i - 1] == c:
                    x, cost = "", toxicity.REPEATED if run >= 3 else toxicity.DOUBLED
                else:
                    fits = False
                    break
            else:
                options = toxicity.READINGS.get(c, "")
                if k < len(options):
                    x, cost = options[k], toxicity.AS_OTHER
                elif k == 2:
                    x, cost = "", toxicity.INSERTED if options else toxicity.SEPARATED
                else:
                    fits = False
                    break
            score += cost
            if x:
                s = ord(x) - 96
                score, a, b, letters = score + gain[a][b][s], b, s, letters + x
        if fits:
            found[letters] = max(found.get(letters, -1e9), score + gain[a][b][0])
    return [(s, x) for x, s in found.items()]


def _restorer(texts):
    n = np.zeros(28**3)
    for t in texts:
        n += toxicity.trigram_counts(np.frombuffer(t.encode(), np.uint8))
    n = n.reshape(28, 28, 28) + 0.1
    return toxicity.Restorer(toxicity.CharModel(np.log(n / n.sum(axis=2, keepdims=True) * 28)))


@pytest.mark.parametrize("noisy", ["you i d 1 o t", "you 1 d i 0 t there", "1d107", "id1ot!", "idiiiot", "i.d.1.0.t", "i-d-i-o-t now", "IDIOT", "(1d10t)"])
def test_disguised_words_are_restored(noisy, texts):
    data = np.frombuffer(noisy.encode(), np.uint8)
    parts = toxicity.plain_and_restored(data, np.array([0, len(data)]), _restorer(t for t in texts.values() if t))
    assert "idiot" in {low[a:b].tobytes().decode() for low, first, last, _ in parts for a, b in zip(first, last)}


def test_restoring_a_long_word_takes_linear_time(texts):
    import time

    gain = _restorer(t for t in texts.values() if t).gain
    begin = time.time()
    assert len(toxicity.restore("ab1c@d0e" * (1 << 17), gain)) > 1 << 19
    assert time.time() - begin < 30


def test_toxicity_recall_and_false_alarms(spark):
    """Of held-out labels, of which some are wrong by design."""
    sf = f"{DATA}/sf0.1"
    scored = queries.QUERIES["op9_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null"), "doc_id").collect()
    toxic, clean = [r for r in scored if r.toxic == 1], [r for r in scored if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)


# --- repeated strings ---------------------------------------------------------------------------------------


def brute_repeats(texts: dict, length: int) -> dict:
    data = {d: (t or "").encode() for d, t in texts.items()}
    seen = collections.Counter(b[i : i + length] for b in data.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in data.items():
        covered = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = True
        c = covered[: len(b)]
        kept = np.frombuffer(b, np.uint8)[~c].tobytes()
        out[d] = (len(b), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_brute_force(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op10_repeats"](spark, SF).collect()}
    assert got == brute_repeats(texts, 200)


@pytest.mark.parametrize("hot", [1, 3, 10**6])
def test_repeats_periodic_and_hot(spark, hot):
    base = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(700))
    texts = {1: "ab" * 400, 2: base, 3: "x" * 50 + base[100:500] + "y" * 90, 4: base[90:380] + "é" * 200, 5: base, 6: None, 7: "z" * 199, 8: "z" * 200, 9: "q" + base[300:600]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans = {k: g for k, g in repeats.repeated_spans(df, hot=hot).toPandas().groupby("key")}
    for d, (n, removed, runs, _) in brute_repeats(texts, 200).items():
        a, b = repeats.merged(spans[d].start.to_numpy(), spans[d].end.to_numpy()) if d in spans else (np.zeros(0), np.zeros(0))
        assert (int((b - a).sum()), len(a)) == (removed, runs), d


def test_deep_shallow_sorts():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 2, (300, 40)).astype(np.uint8)
    s[:, :24] = 1  # all equal down to the shallow depth
    group = rng.integers(0, 3, 300)
    order, common = repeats.deep_shallow(s, group, shallow=16)
    keys = [(group[i], s[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for k in range(1, 300):
        a, b = s[order[k - 1]], s[order[k]]
        expected = -1 if group[order[k - 1]] != group[order[k]] else int((a != b).argmax()) if (a != b).any() else 40
        assert common[k] == expected


@pytest.mark.parametrize("hot", [2, 40])
def test_repeats_one_passage_in_many_texts(spark, hot):
    """A passage that stands in far more texts than a task sorts at once, with other words around it, cut short in some and spoilt in others."""
    rng = np.random.default_rng(4)
    passage = "".join(chr(97 + x) for x in rng.integers(0, 26, 600))
    own = lambda n: "".join(chr(65 + x) for x in rng.integers(0, 26, n))
    texts = {i: own(rng.integers(0, 300)) + passage + own(rng.integers(0, 300)) for i in range(150)}
    texts |= {200 + i: own(50) + passage[: 180 + 7 * i] + own(120) for i in range(20)}
    texts |= {300 + i: passage[: 250 + i] + "#" + passage[251 + i :] for i in range(0, 60, 3)}
    texts[400] = "ab" * 3000 + passage[300:520] + "ab" * 90
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.key: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, hot=hot).collect()}
    assert got == brute_repeats(texts, 200)


def test_repeats_of_rows_and_ids(spark):
    """Rows that repeat an id are judged each for itself; repeated rows are copies."""
    a, b = ("".join(chr(97 + (i * i * k + i) % 26) for i in range(700)) for k in (7, 11))
    rows = [(1, a[:300]), (1, b + "0"), (2, "1" + b), (3, a), (3, a), (4, "short"), (4, "short"), (None, a)]
    got = sorted((r.key, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=2).collect())
    assert got == [(1, 300, 300), (1, 701, 700), (2, 701, 700), (3, 700, 700), (3, 700, 700), (4, 5, 0), (4, 5, 0)]


def test_repeats_odd_inputs(spark, odd, empty):
    got = {r.key: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(odd).collect()}
    assert got[1] == got[2] == got[4] == (0, 0) and got[7][0] > 300_000 and len(got) == 10
    assert repeats.remove_repeats(empty).count() == 0


# --- lines --------------------------------------------------------------------------------------------------


def test_lines_against_sql(spark):
    con = duck("sf0.001")
    ours = queries.QUERIES["op4_line_dedup"](spark, SF).toPandas()
    assert rows_of(ours) == rows_of(con.execute(linededup.ORACLE).df())


def test_lines_within_one_edit(spark):
    base = "abcdefghijklmnopqrstuvwxyz"
    rows = [(1, base + "\nshort"), (2, base[:-1] + "\nX" + base[1:]), (3, base + "!\nshort"), (4, None), (5, ""), (6, base[:5] + base[6:]), (7, "ab" + base[2:20] + "__" + base[22:]), (8, base + "\n" + base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc: r.removed for r in linededup.duplicate_lines(df).collect()}
    assert got == {2: [0, 1], 3: [0, 1], 6: [0], 8: [0, 1]}
    kept = {r.doc_id: r.text for r in linededup.without_duplicate_lines(df).collect()}
    assert not kept.keys() & {2, 3, 8} and kept[4] is None and kept[5] == "" and kept[7] == rows[6][1]
    assert {r.doc: r.removed for r in linededup.duplicate_lines(df, max_edits=0).collect()} == {3: [1], 8: [0, 1]}


@given(st.lists(st.text("aé🙂", min_size=1, max_size=9), min_size=1, max_size=12), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_variants_are_equal_where_texts_are(lines, most):
    """Every wanted place once, and hashes that agree exactly where what remains does."""
    masks = np.arange(len(lines)) * 7 % 15 + 1
    made = [x for part in linededup.variants(pa.array([x.encode() for x in lines]), masks, most) for x in zip(*(y.tolist() for y in part), strict=True)]
    wanted = []
    for row, (line, mask) in enumerate(zip(lines, masks.tolist(), strict=True)):
        for bits, n in ((3, len(line)), (12, len(line) + 1)):
            places = [i for i in range(n) if mask & bits & (0b0101 if i < n // 2 else 0b1010)]
            wanted += [(row, n, i, line[:i] + line[i + 1 :] if bits == 3 else line) for i in places]
    assert sorted(x[:3] for x in made) == sorted(x[:3] for x in wanted)
    remains = {x[:3]: x[3] for x in wanted}
    hashes = collections.defaultdict(set)
    for row, n, i, v in made:
        hashes[remains[row, n, i]].add(v)
    assert all(len(x) == 1 for x in hashes.values()) and len(set().union(*hashes.values())) == len(hashes)


@given(st.text("ab🙂", max_size=7), st.text("ab🙂", max_size=7))
@settings(max_examples=400, deadline=None)
def test_one_edit(a, b):
    assert linededup.within_one_edit(a, b) == (brute_edits(a, b) <= 1)


def test_lines_against_all_pairs(spark):
    """Lines of two letters, so that most have partners; the shortest only go as copies."""
    rng = np.random.default_rng(5)
    rows = [(d, "\n".join("".join(rng.choice(list("ab"), rng.integers(0, 9))) for _ in range(6))) for d in range(30)]
    lines = [(d, no, x) for d, t in rows for no, x in enumerate(t.split("\n")) if x]
    close = lambda a, b: a == b or min(len(a), len(b)) >= 5 and brute_edits(a, b) <= 1
    want = collections.defaultdict(list)
    for k, (d, no, x) in enumerate(lines):
        if any(close(x, y) for _, _, y in lines[:k]):
            want[d].append(no)
    got = linededup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=5).collect()
    assert {r.doc: r.removed for r in got} == dict(want)


def brute_edits(a: str, b: str) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_lines_of_a_million_characters(spark):
    """Work is in proportion to a line's length; blank lines stay where they are."""
    base = " ".join(f"w{i * 7919 % 100_003}" for i in range(150_000))
    rows = [(1, f"{base}\n \n"), (2, base[:400_000] + "#" + base[400_000:]), (3, f" \n{base[:700_000]}#{base[700_001:]}\n\nmore"), (4, base[:300] + "?" + base[302:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    begun = time.time()
    kept = {r.doc_id: r.text for r in linededup.without_duplicate_lines(df).collect()}
    assert len(base) > 900_000 and time.time() - begun < 120
    assert kept == {1: rows[0][1], 3: " \n\nmore", 4: rows[3][1]}


def test_lines_odd_inputs(spark, odd, empty):
    assert linededup.without_duplicate_lines(odd).columns == odd.columns
    assert {r.doc_id for r in linededup.without_duplicate_lines(odd).collect()} >= {1, 2, 3, 4, 5, 7, 9, 10}
    assert linededup.without_duplicate_lines(empty).count() == 0


# --- shards -------------------------------------------------------------------------------------------------


def _check_shards(rows, shards):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(0 <= s < shards for s in by)
    for s in by.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    return {s: sum(r["size"] for r in v) for s, v in by.items()}


def test_shards_are_even(spark, texts):
    rows = queries.QUERIES["op6_histogram_sort"](spark, SF).collect()
    sizes = _check_shards(rows, 40)
    biggest = max(r["size"] for r in rows)
    total = sum(sizes.values())
    assert all(abs(n - total / 40) <= biggest + total / 4000 + 2 for n in (sizes.get(s, 0) for s in range(40)))
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))


@pytest.mark.parametrize("hot", [False, True])
def test_shards_against_a_sort(spark, hot):
    """Shards are ranges of the rows as sorted in memory, and no other cut of that order is nearer, beyond the tolerance."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    if hot:
        docs = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.lit("one text that a third of all rows hold")).otherwise(F.col("text")))
    keys = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    rows = sorted(sharding.shard_by_bytes(docs, 8).select("doc_id", "size", "shard", "slot").collect(), key=lambda r: (keys[r.doc_id], r.doc_id))
    seen = collections.Counter()
    for before, r in zip([rows[0], *rows], rows):
        assert r.shard >= before.shard and r.slot == seen[r.shard]
        seen[r.shard] += 1
    below = np.concatenate([[0], np.cumsum([r["size"] for r in rows])])
    total = int(below[-1])
    for s in range(1, 8):
        cut = sum(n for shard, n in seen.items() if shard < s)
        target = total * s // 8
        assert abs(below[cut] - target) <= max(total * 0.001 / 8, np.abs(below - target).min())


def test_shards_move_the_texts(spark):
    """The digest is taken from what arrives in the shards."""
    plan = queries.QUERIES["op6_histogram_sort"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("crc32(") < plan.index("Window")


def test_shards_with_one_text(spark, odd, empty):
    df = spark.createDataFrame([(i, "same") for i in range(5000)] + [(5000 + i, f"t{i}") for i in range(100)], "doc_id long, text string")
    sizes = _check_shards(sharding.shard_by_bytes(df, 8).collect(), 8)
    assert max(sizes.values()) - min(sizes.values()) <= 120
    _check_shards(sharding.shard_by_bytes(odd, 3).collect(), 3)
    assert sharding.shard_by_bytes(empty, 3).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, None), (3, "b")], "doc_id long, text string")
    assert sharding.shard_by_bytes(nulls, 2).count() == 3


# --- packing ------------------------------------------------------------------------------------------------


def _reference_ids(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = _reference_ids.__dict__.setdefault("t", Tokenizer.from_file(P.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aA 1'sé\n\t<|>.", max_size=60))
def test_same_ids_as_tokenizers(text):
    assert packing.named_codec("byte_bpe_50k.json").encode_ordinary(text) == _reference_ids(text)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>é", "<|endoftext", "plain"])
def test_same_pieces_as_tokenizers_with_added_tokens(spark, text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    ids = np.array([*Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 0], "<u4")
    row = packing.pieces_of(spark.createDataFrame([(1, text)], "doc_id long, text string"), "text", "doc_id", "byte_bpe_50k.json").first()
    assert (row.length, row.ids) == (len(ids), ids.tolist())


def test_packing(spark, texts):
    rows = queries.QUERIES["op7_packing"](spark, SF).collect()
    by, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        places[r.sequence_id].append(r)
    assert set(by) == set(texts)
    for d, own in by.items():
        ids = np.array([*_reference_ids(texts[d] or ""), 0], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and own[-1].start + own[-1].length == len(ids)
        assert all(r.length == 2048 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for own in places.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(places) <= math.ceil(sum(r.length for r in rows) / 2048) + 1


def test_packed_sequences_hold_the_ids(spark, texts):
    packed = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet").limit(40)).collect()
    for r in packed:
        assert r.ids == [*_reference_ids(texts[r.key] or ""), 0][r.start : r.start + r.length]
    assert len(packed) >= 40


def test_local_search_empties_a_bin():
    lengths = [6, 4, 5, 5, 3, 7]
    bins = packing.local_search([[0], [1, 4], [2], [3], [5]], lengths, 10)
    assert sorted(i for b in bins for i in b) == list(range(6)) and len(bins) == 3
    assert all(sum(lengths[i] for i in b) <= 10 for b in bins)


def test_local_search_of_few_lengths():
    """Thousands of pieces of four lengths, for which best fit leaves all bins underfull."""
    lengths = [1030, 524, 518, 500, 500] * 1638
    bins = packing.local_search(packing.best_fit(lengths, 2048), lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert max(sum(lengths[i] for i in b) for b in bins) <= 2048
    assert len(bins) == 2457


@given(st.lists(st.integers(1, 20), max_size=40))
@settings(deadline=None)
def test_local_search_ends_where_no_exchange_helps(lengths):
    bins = packing.local_search(packing.best_fit(lengths, 20), lengths, 20)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    fill = [sum(lengths[i] for i in b) for b in bins]
    assert max(fill, default=0) <= 20
    for a, mine in enumerate(bins):
        for b, theirs in enumerate(bins):
            if a != b and fill[a] <= fill[b]:
                gives = [lengths[i] for i in mine] + [lengths[i] + lengths[j] for k, i in enumerate(mine) for j in mine[k + 1 :]]
                assert not any(0 < x - y <= 20 - fill[b] for x in gives for y in [0, *(lengths[i] for i in theirs)])


def test_packing_odd_inputs(spark, odd, empty):
    rows = packing.pack_documents(odd, sequence=2048).collect()
    assert {r.key for r in rows} == set(range(1, 11)) and {r.length for r in rows if r.key in (1, 2)} == {1}
    assert packing.pack_documents(empty).count() == 0


# --- WebP ---------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000) | st.binary(max_size=4).map(lambda b: b * 700))
def test_webp_round_trip(raw):
    payload = webp.payload_of(raw)
    assert len(payload) % 576 == 0 and len(payload) > 0 and payload[: len(raw)] == raw
    assert webp.load(webp.store(payload)).tobytes() == payload


def _stream(width, height, transforms, image_writer):
    out = webp.Writer()
    out.put(0x2F, 8), out.put(width - 1, 14), out.put(height - 1, 14), out.put(1, 1), out.put(0, 3)
    for t in transforms:
        t(out)
    out.put(0, 1)
    image_writer(out)
    data = out.value.to_bytes((out.n + 7) // 8, "little")
    import struct

    return b"RIFF" + struct.pack("<I", 12 + len(data) + len(data) % 2) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def _plain(flat, outer=True):
    """Literals with eight-bit codes, without copies."""

    def write(out):
        out.put(0, 1)
        if outer:
            out.put(0, 1)
        eight = np.zeros(280, np.int64)
        eight[:256] = 8
        webp.write_code(out, eight)
        for _ in range(3):
            webp.write_code(out, eight[:256])
        webp.write_code(out, np.eye(1, 40, 0, dtype=np.int64)[0])
        code = webp.codes_of(eight)
        for r, g, b, a in flat.reshape(-1, 4).tolist():
            for v in (g, r, b, a):
                out.put(int(code[v]), 8)

    return write


def test_webp_predictor_modes():
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (9, 70, 4)).astype(np.uint8)
    tiles = np.zeros((3, 18, 4), np.uint8)
    tiles[:, :, 1] = np.arange(54).reshape(3, 18) % 14
    whole = image.astype(np.int64)
    residue = np.stack([[(whole[y, x] - webp.prediction(whole, y, x, int(tiles[y >> 2, x >> 2, 1]))) & 255 for x in range(70)] for y in range(9)]).astype(np.uint8)

    def predictor(out):
        out.put(1, 1), out.put(0, 2), out.put(0, 3)
        _plain(tiles, outer=False)(out)

    assert (webp.decode(_stream(70, 9, [predictor], _plain(residue))) == image).all()


def test_webp_cross_colour_and_green():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (8, 9, 4)).astype(np.uint8)
    tiles = rng.integers(0, 256, (2, 3, 4)).astype(np.uint8)
    coded = image.astype(np.int64)
    coded[:, :, 0] -= coded[:, :, 1]
    coded[:, :, 2] -= coded[:, :, 1]
    less = webp.cross_colour((coded & 255).astype(np.uint8), tiles, 2, -1)

    def green(out):
        out.put(1, 1), out.put(2, 2)

    def cross(out):
        out.put(1, 1), out.put(1, 2), out.put(0, 3)
        _plain(tiles, outer=False)(out)

    assert (webp.decode(_stream(9, 8, [green, cross], _plain(less))) == image).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 7, 16])
def test_webp_palette(colours):
    rng = np.random.default_rng(colours)
    palette = rng.integers(0, 256, (colours, 4)).astype(np.uint8)
    image = palette[rng.integers(0, colours, (11, 13))]
    assert (webp.decode(webp.encode(image)) == image).all()


def test_webp_colour_cache_and_copies():
    """A hand-written stream: literals, a copy of the pixel above, and two looks into a cache of 4 bits."""
    pixels = [(10, 20, 30, 255), (40, 50, 60, 255), (70, 80, 90, 1), (11, 12, 13, 14)]

    def slot(p):
        return ((0x1E35A7BD * (p[3] << 24 | p[0] << 16 | p[1] << 8 | p[2])) & 0xFFFFFFFF) >> 28

    def write(out):
        out.put(1, 1), out.put(4, 4), out.put(0, 1)
        green = np.zeros(256 + 24 + 16, np.int64)
        used = sorted({*(p[1] for p in pixels), 256 + 3, *(280 + slot(p) for p in pixels[:2])})
        green[used] = webp.code_lengths(np.ones(len(used), np.int64))
        webp.write_code(out, green)
        rest = np.zeros(256, np.int64)
        values = sorted({p[k] for p in pixels for k in (0, 2, 3)})
        rest[values] = webp.code_lengths(np.ones(len(values), np.int64))
        for _ in range(3):
            webp.write_code(out, rest)
        distance = np.zeros(40, np.int64)
        distance[0] = 1  # code 1: the pixel above
        webp.write_code(out, distance)
        cg, cr = webp.codes_of(green), webp.codes_of(rest)
        for p in pixels:
            out.put(int(cg[p[1]]), int(green[p[1]]))
            for k in (0, 2, 3):
                out.put(int(cr[p[k]]), int(rest[p[k]]))
        out.put(int(cg[259]), int(green[259]))  # four pixels
        for p in pixels[:2]:
            s = 280 + slot(p)
            out.put(int(cg[s]), int(green[s]))

    got = webp.decode(_stream(2, 5, [], write)).reshape(-1, 4).tolist()
    assert got == [list(p) for p in [*pixels, *pixels[2:], *pixels[2:], *pixels[:2]]]


def test_webp_query(spark, texts, odd, empty):
    for r in queries.QUERIES["op2_webp"](spark, SF).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = webp.payload_of(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert webp.read_media(webp.with_media(odd)).count() == 10 and webp.read_media(webp.with_media(empty)).count() == 0
    first = webp.pixels(webp.with_media(odd)).where("doc_id = 4").first().samples
    assert bytes(first.data) == b"a" + b"\xff" * 575


def test_webp_refuses_broken_data():
    good = webp.store(webp.payload_of(b"hello"))
    with pytest.raises(ValueError):
        webp.decode(b"JUNK" + good[4:])


# --- classifiers --------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = f"{DATA}/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    found = [r for r in queries.QUERIES["op3_language"](spark, sf).collect() if r.held_out]
    assert len(found) > 200 and sum(r.lang_pred == langs[r.doc_id] for r in found) / len(found) > 0.97
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in found)
    found = [r for r in queries.QUERIES["op1_quality"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id].quality for r in found) / len(found) > 0.9
    low, high = ([r.score for r in found if labels[r.doc_id].quality == q] for q in (0, 1))
    assert sum(a < b for a in low for b in high) / max(1, len(low) * len(high)) > 0.95
    found = [r for r in queries.QUERIES["op9_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id].toxic for r in found) / len(found) > 0.9


def test_follow_leader_separates():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    rows = [(np.array([3 if v else 5, 10 + int(rng.integers(0, 20))]), np.array([0.9, 0.4])) for v in y]
    w = quality.follow_leader(rows, y, 64)
    assert w[3] > 0.5 and w[5] < -0.5 and np.count_nonzero(w[40:64]) == 0


def _gain():
    text = ("the idiot was stupid and the clown is a moron what a worthless loser this trash is disgusting pathetic " * 50).encode()
    n = toxicity.trigram_counts(np.frombuffer(text, np.uint8)).reshape((toxicity.SYMBOLS,) * 3).astype(float)
    p = (n + 0.05) / (n.sum(axis=2, keepdims=True) + 0.05 * toxicity.SYMBOLS)
    return np.log(p * toxicity.SYMBOLS)


@pytest.mark.parametrize("word,expected", [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("stuuupid", "stupid"), ("$tup1d", "stupid"), ("l0ser", "loser"), ("w0rthl3ss", "worthless"), ("tr@sh", "trash"), ("m0r0n", "moron"), ("idiot", "idiot")])
def test_restore(word, expected):
    assert toxicity.restore(word, _gain().tolist()) == expected


def test_toxicity_finds_disguises_at_the_ends(spark):
    """Look-alikes at either end or in all places, spread look-alikes and doubled letters reach the lattice through with_score."""
    rng = np.random.default_rng(1)
    vocab = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ten") for b in ("ra", "so", "vi") for c in ("", "n", "de")]
    bad = ["idiot", "loser", "stupid", "asshole"]
    rows = [(i, " ".join([*rng.choice(vocab, 30), *([bad[i // 5 % 4]] if i % 5 == 0 else []), *rng.choice(vocab, 30)]), int(i % 5 == 0)) for i in range(800)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(train, train)
    toxic = ["1d107", "$7up1d", "@$$hole", "1d1o7", "10$3r", "(1d107).", "l0$€r", "i d 1 o t", "1 d 1 0 t", "i d i o t!", "idiiot", "1d107!"]
    fine = ["kara", "2019", "1 2 3 4 5", "lo!", "(miso)", "tenso kara"]
    texts = [f"miso {w} loson" for w in toxic + fine]
    got = quality.with_score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert {texts[r.doc_id] for r in got if r.score >= 0.5} == set(texts[: len(toxic)])


def test_toxicity_finds_disguises(spark):
    rng = np.random.default_rng(1)
    vocab = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ten") for b in ("ra", "so", "vi") for c in ("", "n", "de")]
    bad = ["idiot", "moron", "stupid"]
    rows = []
    for i in range(600):
        w = list(rng.choice(vocab, 60))
        if i % 5 == 0:
            w[7] = bad[i % 3]
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    train = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(train, train)
    filler = " ".join(rng.choice(vocab, 20000))
    checks = [("you idiot kara", 1), ("you i.d.i.o.t kara", 1), ("you idiiiiot kara", 1), ("what a m o r o n he is", 1), ("so stup!d loson", 1), (filler, 0), (filler + " idiot", 1), (None, 0), ("", 0), ("kara loso", 0)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(checks)], "doc_id long, text string")
    got = {r.doc_id: int(r.score >= 0.5) for r in quality.with_score(df, model).collect()}
    assert got == {i: y for i, (_, y) in enumerate(checks)}


def test_classifiers_odd_inputs(spark, odd, empty):
    none = empty.selectExpr("doc_id", "text", "cast(null as int) as label")
    q = quality.fit(none)
    assert {r.score for r in quality.with_score(odd, q).collect()} == {0.5}
    t = toxicity.fit(none, empty)
    assert {r.score for r in quality.with_score(odd, t).collect()} == {0.5}
    m = langid.fit(empty.selectExpr("doc_id", "text", "extra as lang"))
    assert {r.lang_pred for r in langid.with_language(odd, m).collect()} == {"und"}
    m = langid.fit(odd.selectExpr("doc_id", "text", "'xx' as lang"))
    got = {r.doc_id: r for r in langid.with_language(odd, m).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[4].lang_pred == "xx"
    assert quality.with_score(empty, q).count() == langid.with_language(empty, m).count() == 0


def test_language_rejects_what_is_far(spark):
    rows = [(i, "der hund und die katze sind im haus " * 3 + str(i), "de") for i in range(40)] + [(100 + i, "the dog and the cat are in the house " * 3 + str(i), "en") for i in range(40)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, "die katze und der hund"), (2, "the cat and the dog"), (3, "zqxj wvkq jjxz qqvw")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.with_language(df, m).collect()}
    assert got[1].lang_pred == "de" and got[2].lang_pred == "en" and got[3].rejected


# --- benchmark ----------------------------------------------------------------------------------------------


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=40))
def test_lcs(a, b):
    assert decontam.lcs(a, b) == _lcs(a, b)


def test_benchmark_passages(spark):
    sf = f"{DATA}/sf0.01"
    docs = {r.doc_id: " ".join((r.text or "").lower().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: " ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    exact = {(d, i) for i, b in items.items() for d, t in docs.items() if b in t}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op5_decontamination"](spark, sf).collect()}
    assert len(exact & got) >= 0.95 * len(exact) and len(got - exact) <= 0.1 * len(exact) + 1


def test_benchmark_paraphrase_and_odd_inputs(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet")
    item = max(bench.collect(), key=lambda r: len(r.text))
    words = item.text.split()
    changed = [w for k, w in enumerate(words) if k % 9 != 4]
    host = "Entirely other words stand before it all. " * 5
    planted = spark.createDataFrame([(900001, host + " ".join(changed) + " " + host), (900002, host * 3), (900003, None), (900004, "")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs.unionByName(planted), bench).collect() if r.doc_id > 900000}
    assert got == {(900001, item.item_id)}
    assert decontam.contaminated(empty, bench).count() == 0
    assert decontam.contaminated(odd, bench.where("false")).count() == 0
    assert decontam.contaminated(odd, bench).where("doc_id < 7").count() == 0


def test_benchmark_short_items(spark):
    """Items of three to twelve words among words as rare as theirs are found, wherever they stand."""
    items = {k: " ".join(f"item{k}x{i}" for i in range(k)) + "." for k in range(3, 13)}
    around = lambda d, n: " ".join(f"own{d}x{i}" for i in range(n))
    rows = [(100 * k + shift, f"{around(100 * k + shift, 11 + shift)} {item} {around(-100 * k - shift, 30)}") for k, item in items.items() for shift in range(8)]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(d, d // 100) for d, _ in rows}


def test_benchmark_words_of_one_document(spark):
    """A passage whose words stand in a single document of many is found, so the latent space knows all documents' words."""
    common, rng = [f"common{i}" for i in range(300)], np.random.default_rng(3)
    prose = lambda n: " ".join(rng.choice(common, n))
    items = [" ".join(f"rare{k}x{i}" for i in range(24)) + "." for k in range(8)]
    rows = [(i, prose(20)) for i in range(6000)] + [(10_000 + k, f"{prose(20)} {item} {prose(20)}") for k, item in enumerate(items)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(10_000 + k, k) for k in range(8)}


def _altered(rng, words, share, vocabulary):
    """The words with that share of them, rounded down, replaced by others at random places."""
    out = list(words)
    for i in rng.choice(len(out), int(share * len(out)), replace=False):
        out[i] = rng.choice(vocabulary)
    return out


def test_benchmark_recall_and_brute_force(spark):
    """Every item planted in prose, word by word and with 10, 20 and 30 % of its words replaced; the search finds what a comparison of all windows with all items finds."""
    rng = np.random.default_rng(11)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    vocabulary = np.array([w for r in docs.where("text is not null").collect() for w in r.text.split()][:50_000])
    prose = lambda: rng.choice(vocabulary, rng.integers(0, 300)).tolist()
    planted = [(share, r.item_id, " ".join(prose() + _altered(rng, r.text.split(), share, vocabulary) + prose())) for share in (0.0, 0.1, 0.2, 0.3) for r in bench.collect()]
    rows = spark.createDataFrame([(1_000_000 + k, t) for k, (_, _, t) in enumerate(planted)], "doc_id long, text string")
    both = docs.unionByName(rows)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(both, bench).collect()}
    for share in (0.0, 0.1, 0.2, 0.3):
        mine = [(1_000_000 + k, item) for k, (s, item, _) in enumerate(planted) if s == share]
        assert sum(m in got for m in mine) >= 0.95 * len(mine), share
    every = {(r.doc_id, r.item_id) for r in decontam.contaminated(both, bench, cosine=-1.0).collect()}
    assert got <= every and len(every - got) <= 0.02 * len(every)


def test_benchmark_repeated_ids_and_clashing_names(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (1, "omicron pi rho sigma tau upsilon phi chi psi omega one two three four")], "item_id long, text string")
    rows = [(7, "so alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi it is", 3, 0.5)] * 2 + [(8, "omicron pi rho sigma tau upsilon phi chi psi omega one two three four", None, None), (None, "alpha", 1, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long, sums double")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()) == [(7, 1), (7, 1), (8, 1)]


def test_rows_that_repeat_an_id(spark):
    """Defined results where an id stands twice, with the same text or another."""
    one, two = "the quick brown fox jumps over the lazy dog today", "an entirely different line of words that stands alone"
    rows = [(1, one), (1, one), (1, two), (2, f"{one}\n{two}"), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = sorted((r.key, r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, size=3, percent=85).collect())
    assert near == [(1, 7, 1), (1, 8, 1), (1, 8, 1), (2, 17, 2), (3, 1, 3)]
    lines = {r.doc: list(r.removed) for r in linededup.duplicate_lines(df).collect()}
    assert lines == {2: [0, 1]}
    assert sorted(r.doc_id for r in linededup.without_duplicate_lines(df).collect()) == [1, 1, 1, 3]
    packed = packing.pack_documents(df).collect()
    assert len(packed) == 5 and sum(r.length for r in packed) == sum(len(packing.encoder_of("byte_bpe_50k.json")(t)) + 1 for _, t in rows)
    assert len({(r.sequence_id, r.offset) for r in packed}) == 5


def test_clashing_names_stay(spark):
    """Columns that carry the names operators use inside come through with their values."""
    names = ["score", "maybe", "gone", "removed", "doc", "near", "letter", "key_hash", "key_id", "cut", "base", "rank", "n_chars"]
    df = spark.createDataFrame([(i, t, *(f"{n}{i}" for n in names)) for i, t in enumerate(["a line of some thirty characters", "a line of some thirty characters\nand more", None, ""])], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    kept = lambda found, leave=(): {r.doc_id: [r[n] for n in names if n not in leave] for r in found.collect()}
    want = lambda ids, leave=(): {i: [f"{n}{i}" for n in names if n not in leave] for i in ids}
    assert kept(linededup.without_duplicate_lines(df)) == want(range(4))
    assert kept(sharding.shard_by_bytes(df, 2)) == want(range(4))
    model = langid.fit(spark.createDataFrame([(1, "some line of characters", "en")], "doc_id long, text string, lang string"))
    assert kept(langid.with_language(df, model), ("score",)) == want(range(4), ("score",))
    assert kept(corpus_pipeline.drop_toxic(spark, df, SF)) == want(range(4))


def test_encoder_uses_every_part_of_the_format(monkeypatch, texts):
    """Stored texts and pictures are read back through each kind of reference and transform."""
    used = collections.Counter()

    def counted(name, real, when=lambda *a: True):
        def call(*a):
            used[name] += bool(when(*a))
            return real(*a)

        monkeypatch.setattr(webp, name, call)

    counted("undo_predictor", webp.undo_predictor)
    counted("cross_colour", webp.cross_colour, lambda *a: a[3] > 0)
    counted("undo_palette", webp.undo_palette)
    resolve = webp._resolved

    def resolved(value, key, copies, cache_bits):
        used["cache"] += cache_bits > 0
        used["runs"] += any(far == 1 for _, _, far in copies)
        used["sequences"] += any(far > 1 for _, _, far in copies)
        return resolve(value, key, copies, cache_bits)

    monkeypatch.setattr(webp, "_resolved", resolved)
    for t in texts.values():
        payload = webp.payload_of((t or "").encode())
        assert webp.load(webp.store(payload)).tobytes() == payload
    long_text = " ".join(t for t in texts.values() if t).encode() + b"*" * 5000
    payload = webp.payload_of(long_text + long_text[:3000])
    assert webp.load(webp.store(payload)).tobytes() == payload
    y, x = np.mgrid[0:70, 0:90]
    rng = np.random.default_rng(1)
    first = []
    for noise in (1, 2, 4):
        for red, blue in ((1.0, 1.0), (0.6, -0.5), (0.2, 0.3)):
            light = 128 + 90 * np.sin(x / 17) * np.cos(y / 23) + rng.integers(0, noise, x.shape)
            image = np.stack([light * red, light, light * blue, np.full(x.shape, 255)], axis=2).astype(np.int64).astype(np.uint8)
            stored = webp.encode(image)
            assert np.array_equal(webp.decode(stored), image)
            bits = webp.Bits(stored, 21 * 8 + 32)
            first.append(bits.read(2) if bits.read(1) else None)
    assert 2 in first  # subtract-green
    assert all(used[k] for k in ("undo_predictor", "cross_colour", "undo_palette", "cache", "runs", "sequences")), used


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 12), st.integers(2, 12))
def test_predictor_rows_at_once(seed, height, width):
    """As pixel by pixel, for every mode and for tiles of different modes in a row."""
    rng = np.random.default_rng(seed)
    residue, modes = rng.integers(0, 256, (height, width, 4), np.uint8), rng.integers(0, 16, (3, 3, 4), np.uint8)
    out = residue.astype(np.int64)
    for y in range(height):
        for x in range(width):
            out[y, x] = (out[y, x] + webp.prediction(out, y, x, int(modes[y >> 2, x >> 2, 1]))) & 255
    assert np.array_equal(webp.undo_predictor(residue, modes, 2), out)


# --- pipeline -----------------------------------------------------------------------------------------------


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        after = after.cache()
        assert 0.5 * before.count() < after.count() <= before.count(), name
        before = after
    near = brute_near({r.doc_id: r.text for r in before.collect()}, 5, 80)
    assert all(d == c for d, (_, c) in near.items())
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    empty_run = corpus_pipeline.STAGES[0][1](spark, docs.where("false"), SF)
    for _, stage in corpus_pipeline.STAGES[1:]:
        empty_run = stage(spark, empty_run, SF)
    assert empty_run.count() == 0


def test_arrow_slices_of_any_kind():
    from voxmere.llm.textvec import slices

    column = pa.chunked_array([["a", None, "bb"], ["", "ccc"]]).combine_chunks().slice(1, 4)
    got = [bytes(data[a:b]) for _, _, data, offs in slices(column, size=2) for a, b in zip(offs[:-1], offs[1:])]
    assert got == [b"", b"bb", b"", b"ccc"]
