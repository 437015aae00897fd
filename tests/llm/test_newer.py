"""Neighbour search, spelling variants and conversation repair against brute force, and odd inputs."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from common import DATA

from pyspark.sql import functions as F
from voxmere.llm import neighbours, queries, repair, variants

SF = f"{DATA}/sf0.01"


# --- nearest neighbours ---------------------------------------------------------------------------------------


def brute_neighbours(rows: list[tuple], asks, k: int) -> dict:
    """Per query id its sorted [(-score, id)]; rows are distinct (id, vector)."""
    out = {}
    for q, v in rows:
        if asks(q):
            best = sorted((-float((np.array(v, float) * np.array(w, float)).sum()), i) for i, w in rows if i != q)[:k]
            out.setdefault(q, []).append(best)
    return out


def listed(frame) -> dict:
    found = collections.defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(found[r.query_id]) + 1
        found[r.query_id].append((-r.score, r.vec_id))
    return dict(found)


def test_neighbours_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute_neighbours(rows, lambda i: i % 20 == 0, 20)
    got = listed(queries.QUERIES["op11_neighbours"](spark, SF))
    assert set(got) == set(want)
    assert all(len(v) == 20 and v == sorted(v) for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q][0]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    vectors = dict(rows)
    for q, found in got.items():
        for minus, i in found:
            assert minus == pytest.approx(-float((np.array(vectors[q], float) * np.array(vectors[i], float)).sum()), abs=1e-14)


def test_neighbours_exhaustive_is_exact_with_copies_and_ties(spark):
    """Whole numbers give exact ties; a vector that a third of the rows share; ids that repeat."""
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(240)]
    rows += [(1000 + i, [1.0, 2.0, -1.0]) for i in range(120)]
    rows += [(7, [9.0, 9.0, 9.0])]
    taking = [(i, v) for i, v in rows if any(v)]
    frame = spark.createDataFrame(rows + [(40, [9.0, 9.0, 9.0]), (40, [9.0, 9.0, 9.0])], "vec_id long, embedding array<double>")
    taking += [(40, [9.0, 9.0, 9.0])]
    got = listed(neighbours.nearest(frame, F.col("vec_id") % 10 == 3, k=5, recall=1.1))
    want = brute_neighbours(taking, lambda i: i % 10 == 3, 5)
    assert got == {q: lists[0] for q, lists in want.items()}


def test_neighbours_leave_unusable_vectors_out(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [-1.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1.5, 2) for i, v in rows], "vec_id long, embedding array<double>, score double, leaf int")
    assert listed(neighbours.nearest(frame, F.lit(True))) == {0: [(-1.0, 6), (1.0, 9)], 6: [(-1.0, 0), (1.0, 9)], 9: [(1.0, 0), (1.0, 6)]}
    assert neighbours.nearest(frame.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(frame.where("vec_id = 0"), F.lit(True)).count() == 0
    assert neighbours.nearest(frame, F.lit(None).cast("boolean")).count() == 0


def test_tree_parts_and_order():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8))
    tree = neighbours.grow(x, 50)
    leaf = neighbours.place(tree, x)
    assert np.bincount(leaf).max() <= 120 and len(np.unique(leaf)) == tree.leaves
    order = neighbours.best_first(tree, x[:20], tree.leaves)
    assert all(sorted(o) == list(range(tree.leaves)) for o in order)
    # the first leaves of a query hold more of its neighbours than as many others
    true = np.argsort(-(x[:20] @ x.T), axis=1)[:, 1:21]
    when = np.argsort(order, axis=1)
    early = np.mean([(when[i, leaf[t]] < tree.leaves // 4).mean() for i, t in enumerate(true)])
    assert early > 0.6


# --- spelling variants ----------------------------------------------------------------------------------------


def brute_counts(rows) -> dict:
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    n = collections.Counter()
    for d, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            if len(word) >= 5:
                n[word] += 1
    return {w: c for w, c in n.items() if c >= 3}


def brute_variants(n: dict) -> dict:
    """Near words by trying every deletion, and every pair of deletions at one place."""
    near, open_at = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            if (v := w[:i] + w[i + 1 :]) in n:
                near[w].add(v)
                near[v].add(w)
            open_at[w[:i], w[i + 1 :]].add(w)
    for group in open_at.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (c, len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w, c in n.items()}


def table_of(frame) -> dict:
    rows = frame.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def test_variants_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert table_of(queries.QUERIES["op12_variants"](spark, f"{DATA}/sf0.001")) == brute_variants(brute_counts(docs))


def test_variants_of_dense_words(spark):
    """All words of up to five of three letters: runs of one letter, every kind of edit, and long chains of forms."""
    rng = np.random.default_rng(8)
    n = {"".join(w): int(rng.integers(1, 2000)) for k in range(1, 6) for w in itertools.product("abé", repeat=k) if rng.random() < 0.7}
    got = table_of(variants.grouped(spark.createDataFrame(sorted(n.items()), "word string, n long")))
    assert got == brute_variants(n)


def test_variants_chain_and_very_long_words(spark):
    long_word = "".join("abcdefgh"[int(x)] for x in np.random.default_rng(1).integers(0, 8, 300_000))
    n = {"b" * k: 4**k for k in range(1, 12)} | {long_word: 3, long_word[:150_000] + long_word[150_001:]: 9, long_word[:-1] + "z": 30}
    got = table_of(variants.grouped(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got["b"] == (4, 1, "bb", 16, "b" * 11) and got["b" * 11][1:] == (1, None, None, "b" * 11)
    assert got[long_word][1] == 2 and got[long_word][2] == long_word[:-1] + "z"


def test_variants_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "12 34 -- x"), (None, "Ünder under UNDER ündér"), (4, "under1under under,under"), (5, "z" * 2000), (5, "z" * 2000), (5, "z" * 2000), (6, "a÷b×cÀÿ" * 3)]
    frame = spark.createDataFrame([(d, t, 5, "x", 1) for d, t in rows], "doc_id long, text string, n long, word string, root int")
    assert table_of(variants.grouped(variants.counted_words(frame))) == brute_variants(brute_counts(rows))
    assert variants.grouped(variants.counted_words(frame.limit(0))).count() == 0
    assert variants.grouped(spark.createDataFrame([(None, 3), ("", 2)], "word string, n long")).count() == 0


# --- conversations --------------------------------------------------------------------------------------------


def brute_solve(signature: str) -> tuple[int, str]:
    """The cheapest and then least audit among all: every edit of every row, with up to two rows put in at every place."""
    best = None
    per_row = [["D"] if s == "d" else ["D", "K", "Ru", "Ra"] for s in signature]
    inserts = ["", "u", "a", "ua", "au"]
    for rows in itertools.product(*per_row):
        for put in itertools.product(inserts, repeat=len(signature) + 1):
            roles, audit, cost = "", "", 0
            for i in range(len(signature) + 1):
                roles, audit, cost = roles + put[i], audit + "I" * len(put[i]), cost + 2 * len(put[i])
                if i < len(signature):
                    audit += rows[i][0]
                    if rows[i] == "D":
                        cost += 3
                    else:
                        cost += (2 if rows[i][0] == "R" else 0) + signature[i].isupper()
                        roles += rows[i][1:] or signature[i].lower()
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_solve_brute_force(n):
    letters = "suaoSUAOd" if n < 3 else "suaUd"
    for signature in map("".join, itertools.product(letters, repeat=n)):
        assert repair.solve(signature) == brute_solve(signature), signature


def test_solve_long_signature():
    cost, audit = repair.solve("s" + "ua" * 100_000 + "u")
    assert (cost, audit) == (2, "K" * 200_002 + "I")


def brute_repair(rows: list[tuple], harm: bool) -> dict:
    told = lambda v: " " if v is None else v
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        out = by[conv]
        role, text = told(role), told(text)
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20 if harm else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    found = {}
    for conv, out in by.items():
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults, signature = set(), collections.Counter(), ""
        for _, role, text in out:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signature += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        turns = [t for t, _, _ in out if t is not None]
        initials = [r[:1] for _, r, _ in out]
        cost, audit = repair.solve(signature)
        lines, at = [], iter(out)
        for edit in audit:
            row = next(at) if edit != "I" else None
            last = lines[-1][0][:1] if lines else ""
            wanted = "assistant" if last == "u" else "user"
            if edit != "D":
                lines.append((row[1], row[2]) if edit == "K" else (wanted, row[2] if row else ""))
        repaired = "\n".join(f"{r}:{t}" for r, t in lines)
        found[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(repaired.encode()).hexdigest())
    return found


def repaired_of(frame) -> dict:
    rows = frame.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def test_repair_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_repair"](spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert repaired_of(got) == brute_repair(rows, True)


def test_repair_of_odd_rows(spark):
    rows = [
        (1, 0, "system", "You."), (1, 1, "user", "a"), (1, 2, "user", "b."), (1, 2**40, "assistant", "c!\x0b\n "),
        (2, None, None, "x."), (2, None, "user", None), (2, 3, "user", " \t"), (2, 3, "", "y?"),
        (None, 1, "user", "q?"), (None, 2, "assistant", "r."), (None, 3, "user", "q?"),
        (3, 1, "tool", "z."), (4, 1, "assistant", "é" * 300_000), (5, 1, "user", "1."), (5, 1, "user", "1."),
    ]
    kind = "conv_id long, turn long, role string, text string"
    frame = spark.createDataFrame([(*r, 1, "h", 3) for r in rows], kind + ", copy int, audit string, cost int")
    # rows of one turn have no order of their own: only conversation 5, of equal rows, and 2, whose first two may change places
    got, want = repaired_of(repair.repaired(frame)), brute_repair(rows, False)
    swapped = brute_repair([rows[5], rows[4], *rows[6:8]], False), brute_repair([*rows[4:6], rows[7], rows[6]], False), brute_repair([rows[5], rows[4], rows[7], rows[6]], False)
    assert got.pop(2) in (want.pop(2), *(s[2] for s in swapped))
    assert got == want
    assert repair.repaired(frame.limit(0)).count() == 0
    assert repaired_of(repair.repaired(frame.where("conv_id = 5")))[5][:3] == (0, 0, 1)


def test_repair_where_all_rows_go(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"77:{t}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(77, gone, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert repaired_of(repair.repaired(frame, before=repair.damaged)) == {77: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repair_of_text_keys(spark):
    frame = spark.createDataFrame([("a", 1, "user", "x."), ("b", 1, "user", "x."), ("a", 2, "assistant", "y.")], "conv_id string, turn long, role string, text string")
    assert {k: v[5:7] for k, v in repaired_of(repair.repaired(frame)).items()} == {"a": (0, "KK"), "b": (2, "KI")}
