"""Filter audits, exact duplicates and spelling variants against plain loops."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from candlewick.llm import exact_dedup, filter_audit, spelling
from tests.llm.fixtures import texts

QUERIES = __spark_entry__.queries()
DOCS = "doc_id bigint, text string, lang string, n bigint, MASK string, part string, word string, digest string, id string, `a.b` map<string,int>"


def rows(seed: int = 3) -> list[tuple[int | None, str | None, str | None]]:
    """Texts of few and many words, with capitals, symbols, copies and variants, in four parts, one without a name and one of null."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéÈ×ÿz") for _ in range(r.randint(3, 8))) for _ in range(60)]
    made = []
    for i in range(120):
        text = " ".join(r.choice(words[: r.choice([5, 60])]) for _ in range(r.choice([3, 150, 198, 230])))
        text += r.choice(["", " #", "|x"]) + r.choice(["", " ABCDEFGHIJ"])
        made.append((i, text.upper() if r.random() < 0.1 else text, r.choice(["en", "de", "", None])))
    made += [(200 + i, made[i % 7][1], "en") for i in range(30)] + [(201, made[1][1], "fr"), (201, made[1][1], "fr"), (None, made[2][1], "en"), (None, None, None)]
    return made + [(300 + i, t, "en") for i, t in enumerate([None, "", " \t\n", "word " * 50_000, "x" * 100_000, "x" * 100_000 + " " + "x" * 100_000])]


def frame(spark, data):
    return spark.createDataFrame([(i, t, p, 1, "m", "p", "w", "d", "x", {"a": 1}) for i, t, p in data], DOCS).repartition(5, "doc_id")


def failing(data) -> list[int]:
    """The mask of each row, by a plain loop."""
    firsts: dict[str, int] = {}
    for i, t, _ in data:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    out = []
    for i, t, _ in data:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tests = [len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * len(re.findall("[A-Z]", t or "")) > 3 * len(t or ""), bool(re.search(r"[#$%&*|]", t or "")), i is not None and i > firsts[t or ""]]
        out.append(sum(1 << k for k, x in enumerate(tests) if x))
    return out


def audited(data, good, toxic) -> dict:
    masks, out = failing(data), {}
    for part in {p or "" for _, _, p in data}:
        own = [(m, i) for (i, _, p), m in zip(data, masks, strict=True) if (p or "") == part]
        shapley: Counter = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [x for x in left if x[0] & bit]
                fails = sum(1 for m, _ in own if m & bit)
                left = [x for x in left if not x[0] & bit]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(m == bit for m, _ in own), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_lehmer_ranks_and_intervals():
    orders = ["".join(p) for p in permutations("ABCDE")]
    assert [filter_audit.lehmer_rank(o) for o in orders] == list(range(120)) and filter_audit.lehmer_rank("BA") == orders.index("BACDE")
    table = defaultdict(lambda: np.zeros(121, int))
    for mask, step, rank, sign in filter_audit.differences():
        table[mask, step][rank] += sign
    for mask in range(32):
        for step in range(1, 6):
            bits = [[mask >> "ABCDE".index(f) & 1 for f in o[:step]] for o in orders]
            assert np.cumsum(table[mask, step])[:120].tolist() == [int(b[-1] == 1 and not any(b[:-1])) for b in bits]


def test_filter_audit(spark):
    data = rows()
    labels = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 250)] + [(4, 1, 1), (None, 1, 1), (7, None, None)]
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    known = spark.createDataFrame([(*x, "n") for x in labels], "doc_id bigint, quality int, toxic int, N string")
    found = filter_audit.filter_audit(frame(spark, data), known).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}
    assert len(found) == len(got) and got == audited(data, good, toxic) and {k[0] for k in got} == {"en", "de", "fr", ""}
    assert filter_audit.filter_audit(frame(spark, data).limit(0), known).count() == 0


def test_filter_audit_without_labels(spark):
    found = filter_audit.filter_audit(frame(spark, [(1, "a", "x")]), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()
    assert len(found) == 600 and {r.good_lost + r.toxic_lost for r in found} == {0} and sum(r.removed for r in found) == 120


def exact(data) -> list[tuple]:
    groups = defaultdict(list)
    for at, (i, t) in enumerate(data):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, at))
    out = []
    for key, own in groups.items():
        best = min(own)
        for x in own:
            out.append((None if x[1] else x[2], None if best[1] else best[2], len(own), x == best, sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("data", [texts(), [(i, t) for i, t, _ in rows()], [(3, "a b"), (2, "ab "), (1, "ab"), (2, "ab "), (None, "a\tb"), (9, "c"), (9, " c"), (9, "c")], []])
def test_exact_dedup(spark, data):
    found = exact_dedup.exact_dedup(frame(spark, [(i, t, "x") for i, t in data])).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in found), key=repr) == exact(data)


def test_exact_index_inserts_and_deletes(spark):
    """After any insertions and deletions the groups are those of the documents that are left."""
    r = random.Random(5)
    data = [(i, r.choice(["a", "a ", " a", "bb", "b b", "c" * (i % 9), f"own {i}"])) for i in range(400)]
    made = lambda part: spark.createDataFrame(part, "doc_id bigint, text string")
    index, live = exact_dedup.exact_index(made(data[:150])), data[:150]
    for step in range(3):
        gone = {i for i, _ in live if r.random() < 0.4} | {min(live, key=lambda x: (-len(x[1]), x[0]))[0]}
        index, live = index.delete(made([(i, "") for i in [*gone, 9999]] * 2)), [x for x in live if x[0] not in gone]
        more = data[150 + 80 * step : 230 + 80 * step] + ([data[3]] if data[3] not in live else [])
        index, live = index.insert(made(more)), live + more
        if step == 1:
            index = exact_dedup.grown(index)
        found = sorted(((x.id, x.keep_id, x.group_size, x.kept, bytes(x.digest).hex()) for x in index.groups().collect()), key=repr)
        assert found == exact(live)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 400)), max_size=1500))
def test_cuckoo_filter(changes):
    """Live digests are always found, others never; a full filter grows from the stored ones."""
    index, want = exact_dedup.CuckooIndex(size=1), Counter()
    for add, x in changes:
        digest = sha256(bytes([x % 256, x // 256])).digest()
        if add:
            index.add(digest, 1, (0, x, x))
            want[x] += 1
        elif want[x]:
            index.remove(digest, 1, (0, x, x + 1))
            want[x] -= 1
    want = +want
    assert index.live == len(want) and sorted(e[1] for e in index.entries()) == sorted(want.values())
    for x in range(450):
        entry = index.find(sha256(bytes([x % 256, x // 256])).digest())
        assert (entry[1] if entry else 0) == want[x]
    assert sum(f > 0 for f in index.filter) == len(want) and (index.resized > 0 or len(want) <= 8)


def test_most_misses_need_no_content():
    index = exact_dedup.CuckooIndex()
    for x in range(20_000):
        index.add(sha256(str(x).encode()).digest(), 1, (0, x, x))
    before = index.verified
    assert sum(index.find(sha256(str(x).encode()).digest()) is not None for x in range(20_000, 120_000)) == 0
    assert index.verified - before < 100 and index.resized > 3


def plain_words(data) -> Counter:
    found: Counter = Counter()
    for i, t in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            found[run] += 1
    return Counter({w: n for w, n in found.items() if len(w) >= 5 and n >= 3})


def is_near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :]


def plain_variants(data) -> list[tuple]:
    n = plain_words(data)
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def misspelt(seed: int = 8) -> list[tuple[int | None, str | None]]:
    """Words with edits of edits, often enough each, among letters beyond ASCII and other signs."""
    r, made = random.Random(seed), []
    letters = "abßéÈÿ×zqT"
    pool = ["".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(12)]
    weights = [400 // (k + 1) for k in range(12)]
    for _ in range(3):
        for w, k in list(zip(pool, weights, strict=True)):
            p = r.randrange(len(w))
            pool.append(r.choice([w[:p] + w[p + 1 :], w[:p] + r.choice(letters) + w[p:], w[:p] + r.choice(letters) + w[p + 1 :]]))
            weights.append(max(3, k // 3))
    for i in range(150):
        made.append((i, "".join(r.choices(pool, weights)[0] + r.choice([" ", "\n", "-", "日", "1", "’", "Ł"]) for _ in range(r.randint(0, 90)))))
    long = "".join(r.choice("abc") for _ in range(5000))
    return made + [(5, made[5][1]), (5, made[5][1]), (None, made[6][1]), (None, None), (900, None), (901, "")] + [(910 + k, f"{long} {long[:700]}é{long[701:]} {long[:9]}{long[10:]}") for k in range(4)]


@pytest.mark.parametrize("symbols", [None, 2, 31])
def test_spelling_variants(spark, symbols):
    data = misspelt()
    want = plain_variants(data)
    found = spelling.spelling_variants(frame(spark, [(i, t, "x") for i, t in data]), symbols=symbols).collect()
    assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found), key=repr) == want
    assert sum(x[1] is not None for x in want) > 20 and any(x[1] not in (None, x[2]) for x in want)


def test_spelling_of_nothing_and_of_long_texts(spark, monkeypatch):
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    data = [(i, "abcde é" * 3000 + "q" * 90) for i in range(3)]
    want = plain_words(data)
    assert {r.word: r.n for r in spelling.word_counts(frame(spark, [(i, t, "x") for i, t in data])).collect()} == want
    monkeypatch.setattr(spelling, "PIECE", 7)  # cuts inside texts never cut a word
    text = "abcdefghij,éÿéÿéÿéÿ-x " * 30
    data = np.frombuffer(text.encode(), np.uint8)
    cut = [w for d, o, _ in spelling._pieces(spelling.X.Slice(data, np.array([0, len(data)]), (0, 1))) for w in spelling.words_of(d, o, ["7"]).to_pylist()]
    assert cut == spelling.words_of(data, np.array([0, len(data)]), ["7"]).to_pylist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="012", min_size=1, max_size=7), min_size=1, max_size=6))
def test_neighbourhoods(made):
    """The hashes are those of all one-edit strings, each once, and of the strings themselves."""
    got = defaultdict(list)
    for keys, of in spelling.neighbourhoods(pa.array(made), 3):
        for k, i in zip(keys.tolist(), of.tolist(), strict=True):
            got[i].append(k)
    for i, w in enumerate(made):
        want = {w} | {w[:p] + w[p + 1 :] for p in range(len(w))} | {w[:p] + c + w[p:] for p in range(len(w) + 1) for c in "012"} | {w[:p] + c + w[p + 1 :] for p in range(len(w)) for c in "012"}
        assert sorted(got[i]) == sorted(spelling.codes(pa.array(sorted(want))).tolist())
    code = dict(zip(made, spelling.codes(pa.array(made)).tolist(), strict=True))
    pairs = Counter((code[made[i]], k) for keys, of in spelling.neighbourhoods(pa.array(sorted(code)), 3, one_side=True) for k, i in zip(keys.tolist(), [made.index(sorted(code)[i]) for i in of.tolist()], strict=True))
    for a in code:
        for b in code:
            assert pairs[code[a], code[b]] + pairs[code[b], code[a]] == (2 if a == b else is_near(a, b))


def test_queries_give_what_operators_do(spark, tmp_path):
    data = [(i, t, "en") for i, (_, t) in enumerate(texts())]
    frame(spark, data).select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = QUERIES["op13_spelling"](spark, str(tmp_path)).collect()
    assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found), key=repr) == plain_variants([(i, t) for i, t, _ in data])
    assert QUERIES["op12_exact_dedup"](spark, str(tmp_path)).where("kept").count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in data})
    assert QUERIES["op11_filter_audit"](spark, str(tmp_path)).agg(F.sum("removed")).first()[0] == 120 * sum(m > 0 for m in failing(data))


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_exact_dedup"])
def test_queries_give_what_sql_does(spark, tmp_path, name):
    data = [(i, t, p) for i, (_, t, p) in enumerate(rows())]
    db = duckdb.connect()
    for table, made in (("documents", frame(spark, data).select("doc_id", "text", "lang")), ("labels", spark.createDataFrame([(i, i % 2, i % 3) for i in range(99)], "doc_id bigint, quality int, toxic int"))):
        made.write.parquet(f"{tmp_path}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    made = db.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in made.description]
    found = QUERIES[name](spark, str(tmp_path)).select(*names)
    assert Counter(map(tuple, found.collect())) == Counter(made.fetchall())
