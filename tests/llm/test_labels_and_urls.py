"""Learnt operators by brute force and held-out accuracy, URL rules and models by brute force, the pipeline by its parts."""

from __future__ import annotations

import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from candlewick.llm import jaccard_join, quality_knn, samples, toxicity, url_filter
from candlewick.llm import textops as X
from tests.llm.fixtures import documents, texts


def corpus(seed: int = 3):
    r = random.Random(seed)
    words = ["".join(r.choice("aeiorstnlm") for _ in range(r.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(400):
        prose = " ".join(r.choices(words, k=r.randint(60, 120)))
        good, toxic = i % 3 != 0, i % 4 == 1
        if not good:
            prose = " ".join(w.upper() + "!!" for w in prose.split()) if i % 2 else " ### ".join(prose.split())
        if toxic:
            prose += " you vile grobnik and " + " ".join(r.choices(["vile", "grobnik", "snarl"], k=3))
        docs.append((i, prose))
        labels.append((i, int(good), int(toxic)))
    return docs + [(None, None), (1000, ""), (1001, None), (1, docs[1][1])], labels


def test_quality_knn(spark):
    docs, labels = corpus()
    known = {i: q for i, q, _ in labels}
    marked = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = quality_knn.quality_knn(documents(spark, docs), marked, per_class=100).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.score >= 0.3) == (known[r.doc_id] == 1) for r in rows if r.held_out and r.doc_id in known]
    assert sum(held) / len(held) > 0.95
    assert all(r.score == 0.5 for r in quality_knn.quality_knn(documents(spark, docs), marked.limit(0)).collect())


def test_votes_are_those_of_the_nearest_rows():
    r = np.random.default_rng(5)
    x = np.log1p(r.integers(0, 3, (300, quality_knn.DIMENSIONS))).astype(np.float32)
    x[40:60] = x[20:40]  # equally near rows
    labels = r.integers(0, 2, 300).astype(float)
    space = quality_knn.fit(x, labels)
    asked = np.concatenate([x[:50], np.log1p(r.integers(0, 3, (250, quality_knn.DIMENSIONS))).astype(np.float32)])
    want = []
    for v in space.place(asked):
        near = [round(float(v @ w) * 100_000) for w in space.vectors]
        best = sorted(range(len(near)), key=lambda i: (-near[i], i))[: quality_knn.NEIGHBOURS]
        weight = [max(near[i], 1) ** 4 for i in best]
        want.append(sum(w * labels[i] for w, i in zip(weight, best, strict=True)) / sum(weight))
    got = space.vote(asked)
    assert np.abs(got - np.array(want)).max() < 2e-3 and np.median(np.abs(got - np.array(want))) < 1e-5
    assert (space.vote(asked[:7]) == got[:7]).all() and (space.vote(x[40:60]) == space.vote(x[20:40])).all()


def test_toxicity(spark):
    docs, labels = corpus()
    known = {i: t for i, _, t in labels}
    marked = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = toxicity.toxicity(documents(spark, docs), marked).collect()
    assert len(rows) == len(docs)
    right = [r.is_toxic == (known[r.doc_id] == 1) for r in rows if r.doc_id in known]
    assert sum(right) / len(right) > 0.97
    assert not any(r.is_toxic for r in rows if r.doc_id not in known)
    unknown = toxicity.toxicity(documents(spark, docs), marked.limit(0)).collect()
    assert len(unknown) == len(docs) and not any(r.is_toxic or r.p_toxic or r.p_core for r in unknown)
    for kind in (0, 1):
        rows = toxicity.toxicity(documents(spark, docs), marked.where(f"toxic = {kind}")).collect()
        assert {r.is_toxic for r in rows} == {kind == 1}
    assert toxicity.toxicity(documents(spark, []), marked).count() == 0


def test_links_know_more_by_the_chain():
    """Documents with words of one group, or of another: without earlier probabilities a link, which doesn't see its own words, knows little."""
    r = random.Random(6)
    groups, plain = (["vile", "grobnik", "snarl"], ["zott", "ploom", "krax"]), [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    texts, label, kinds = [], [], []
    for _ in range(900):
        kind = r.choice([None, None, None, 0, 0, 1])
        texts.append(" ".join(r.choices(plain, k=30) + (r.choices(groups[kind], k=3) if kind is not None else [])))
        label.append(kind is not None)
        kinds.append(kind)
    words = [w.encode() for g in groups for w in g]
    part = next(X.slices(pa.array(words, pa.binary()).cast(pa.string())))
    hashes = np.sort(X.span_hashes(part.data, part.offsets[:-1], part.offsets[1:], X.LOWER_CODES))
    counts, n_words = toxicity.word_counts(next(X.slices(pa.array(texts))), hashes)
    first = int(np.flatnonzero(counts[kinds.index(0)])[0])
    listed = np.array([first, *(i for i in range(6) if i != first)])
    y, learnt, held = np.array(label, float), np.arange(900) < 600, np.arange(900) >= 600
    links = toxicity.train(counts[learnt], n_words[learnt], y[learnt], np.arange(600) % samples.FOLDS, [listed] * (samples.FOLDS + 1))
    p = toxicity.Chain(hashes, links).probabilities(counts[held], n_words[held])
    want = np.array([[k is not None, k == 0, k == 1] for k in kinds])[held]
    assert ((p >= 0.5) == want).mean(axis=0).min() > 0.97
    for i in (1, 2):
        seen = links[i][0]
        alone = samples.logistic(toxicity.design(counts[learnt], n_words[learnt], seen), np.array([k == i - 1 for k in kinds], float)[learnt])
        recall = (samples.probability(toxicity.design(counts[held], n_words[held], seen), alone) >= 0.5)[want[:, i]].mean()
        assert recall < 0.2


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, None
    host, path, _ = re.match(r"([^/?#]*)([^?#]*)(.*)", url.split("://", 1)[1], re.S).groups()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in url_filter.RULES:
        own, rest = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best and best[1], best and best[0]


def test_url_filter(spark):
    r = random.Random(4)
    urls = [f"http{r.choice(['', 's'])}://{r.choice(['', 'www.', 'A.b.'])}{r.choice(['example', 'Shop', 'news'])}.{r.choice(['org', 'com', 'net'])}{r.choice(['', '/', '/fr/', '/de/x', '/es/1', '/en/12', '/en/2'])}{r.choice(['', '?a=/de/', '#top'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "a://", "x://EXAMPLE.ORG/es/", "http://org", "http://org/", "ftp://h://org/a", urls[0], urls[0]]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    rows = url_filter.url_filter(pages).collect()
    assert len(rows) == len(urls)
    for x in rows:
        host, path, rule, verdict = judged(x.url)
        assert (x.host, x.path, x.rule) == (host, path, rule), x
        assert x.verdict == verdict if verdict else x.verdict in ("allow", "block")
    assert url_filter.url_filter(pages.limit(0)).count() == 0
    assert len({x.verdict for x in rows if x.url == urls[0]}) == 1


def _probabilities(urls: list[tuple[str, str | None, int, bool]]) -> dict[str, float]:
    """The log ratio of each gram, by recursion over its contexts."""
    k = url_filter.CONTEXT
    marked = [("^" * k + re.sub(f"[^{re.escape(url_filter.SYMBOLS)}]", "~", lower(u)), v, n if trains else 0) for u, v, n, trains in urls]
    counts = {v: Counter() for v in ("allow", "block")}
    grams = set()
    for text, verdict, n in marked:
        for i in range(k, len(text)):
            grams.add(text[i - k : i + 1])
            for j in range(k + 1):
                if verdict:
                    counts[verdict][text[i - j : i + 1]] += n
    after = {v: defaultdict(list) for v in counts}
    for v, c in counts.items():
        for s, n in c.items():
            after[v][s[:-1], len(s)].append(n)

    def p(v: str, s: str) -> float:
        if len(s) == 1:
            return (counts[v][s] + 1) / (sum(after[v]["", 1]) + url_filter.SIZE)
        total = {x: sum(after[x][s[:-1], len(s)]) for x in counts}
        shorter = p(v, s[1:])
        if sum(total.values()) < url_filter.SUPPORT:
            return shorter
        kinds = max(1, sum(n > 0 for n in after[v][s[:-1], len(s)]))
        return (counts[v][s] + kinds * shorter) / (total[v] + kinds)

    return {g: math.log(p("allow", g)) - math.log(p("block", g)) for g in grams}


def lower(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def test_url_scores_and_threshold(spark):
    r = random.Random(7)
    good, bad, hosts = ["news", "docs", "wiki", "library"], ["win", "casino", "pills", "click-here"], ["a.org", "b.com/fr", "c.com/de", "d.net", "e.net"]
    urls = []
    for i in range(600):
        host = r.choice(hosts)
        kind = good if host in ("a.org", "b.com/fr") or (host.endswith("net") and i % 2) else bad
        urls.append(f"http://{host}/{r.choice(kind)}/{r.choice(kind)}-{r.randint(0, 99)}")
    urls += [urls[0]] * 300 + [None] * 200 + ["", "http://d.net/" + "x" * 50_000, "http://É.net/\n日本"]
    rows = url_filter.url_filter(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").repartition(3)).collect()
    assert len(rows) == len(urls)
    times = Counter(u for u in urls if u is not None)
    given = {u: judged(u)[3] for u in times}
    trains = {u: zlib.crc32(u.encode()) % samples.FOLDS != samples.HELD_OUT for u in times}
    ratio = _probabilities([(u, given[u], n, trains[u]) for u, n in times.items()])

    def score(u: str) -> float:
        text = "^" * url_filter.CONTEXT + re.sub(f"[^{re.escape(url_filter.SYMBOLS)}]", "~", lower(u))
        return sum(ratio[text[i : i + url_filter.CONTEXT + 1]] for i in range(len(u))) / len(u) if u else 0.0

    want = {u: score(u) for u in times}
    for x in rows:
        assert abs(x.score - (want[x.url] if x.url is not None else 0)) < 1e-5
    held = {v: [want[u] for u, n in times.items() if given[u] == v and not trains[u] for _ in range(n)] for v in ("allow", "block")}
    (a, sa), (b, sb) = ((np.mean(held[v]), np.std(held[v])) for v in ("allow", "block"))
    limit = (a * sb + b * sa) / (sa + sb)
    for x in rows:
        if x.rule is None and abs(x.score - limit) > 1e-4:
            assert x.verdict == ("allow" if x.score >= limit else "block")
    net = [(x.verdict == "allow") == any(g in x.url for g in good) for x in rows if x.url and re.match(r"http://[de]\.net/[a-w]", x.url)]
    assert sum(net) / len(net) > 0.95


PIPELINE_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, _row string, spans string, base_spans string, apart string, n_words string, c0 string, component_id string, n_removed string, chunk string"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or ""), *"ktabcdefgh") for i, t in texts()]
    spark.createDataFrame(rows, PIPELINE_SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            first = out.drop("doc_id", "text", "n_chars").distinct().collect()
            assert [tuple(r) for r in first] == [("en", "s", *"ktabcdefgh")]
            assert out.where("n_chars <> length(text)").count() == 0
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.count())
    assert seen[0] > seen[1] == seen[2] == seen[3] > 0
    found = sorted(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect(), key=repr)
    assert found == sorted(docs.select("doc_id", "start", "length", "ids_crc32").collect(), key=repr)


def test_pipeline_without_rows_and_with_few_columns(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_urls_and_any_columns(spark):
    """A URL of 100,000 characters; columns of the names of helpers, with dots and of maps stay."""
    urls = ["http://x.net/" + "abc/" * 25_000, "http://a.org/x", "http://b.com/de/y", None]
    pages = spark.createDataFrame([(i, u, "g", "h", {"k": 1}, "d") for i, u in enumerate(urls)], "page_id bigint, url string, given string, hot_score string, m map<string,int>, `a.b` string")
    found = url_filter.url_filter(pages)
    assert found.columns == [*pages.columns, "host", "path", "rule", "score", "verdict"]
    rows = {r.page_id: r for r in found.collect()}
    assert len(rows) == 4 and all(r.given == "g" and r.hot_score == "h" and r.m == {"k": 1} and r["a.b"] == "d" for r in rows.values()) and rows[1].verdict == "allow" and rows[0].rule is None


def test_pipeline_keeps_any_columns_and_one_row_of_an_id(spark):
    import corpus_pipeline

    rows = [(i, t, {"k": i or 0}, "dot", "upper", len(t or "")) for i, t in texts()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, m map<string,int>, `a.b` string, COMPONENT_ID string, n_chars int")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        found = stage(spark, docs, "")
        assert found.columns == docs.columns, name
        assert {r["a.b"] for r in found.select("`a.b`").collect()} == {"dot"}
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    classes = jaccard_join.jaccard_join(docs.select("doc_id", "text")).collect()
    firsts = {r.doc_id for r in classes if r.doc_id is not None and r.doc_id == r.component_id}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(firsts) and sum(r.doc_id is None for r in kept) == sum(i is None for i, _ in texts())
    again = corpus_pipeline.near_duplicates(spark, docs.repartition(7), "").collect()
    assert sorted(map(str, again)) == sorted(map(str, kept))


def test_a_run_leaves_nothing(spark, tmp_path):
    import os

    from candlewick.sources import shared

    base = shared.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(base))
    docs = spark.createDataFrame([(i, t) for i, t in texts()], "doc_id bigint, text string")
    with shared.run(spark) as folder:
        jaccard_join.jaccard_join(docs).write.parquet(f"{tmp_path}/out")
        assert folder.startswith(shared.shared_folder(spark)) and os.listdir(folder.removeprefix("file:"))
    assert set(os.listdir(base)) == before and spark.read.parquet(f"{tmp_path}/out").count() == len(texts())
    with pytest.raises(ZeroDivisionError), shared.run(spark):
        shared.written(docs, "x")
        raise ZeroDivisionError
    assert set(os.listdir(base)) == before


def test_pipeline_deletes_what_later_steps_do_not_read(spark, tmp_path):
    """Of the near duplicates only the ids that stay are left when the texts are joined, of a whole run only what the stages return."""
    import os

    import corpus_pipeline
    from candlewick.sources import shared

    def left(folder):
        return sorted(x.rpartition("-")[0] for x in os.listdir(folder.removeprefix("file:")))

    docs = spark.createDataFrame([(i, t) for i, t in texts()], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stay = jaccard_join.jaccard_join(docs).where("doc_id = component_id").select("doc_id").distinct().count() + docs.where("doc_id is null").count()
    with shared.run(spark) as folder:
        kept = corpus_pipeline.near_duplicates(spark, docs, "")
        assert left(folder) == ["first-ids"] and kept.count() == stay
    with shared.run(spark) as folder:
        assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
        assert left(folder) == sorted(f"stage-{name}" for name, _ in corpus_pipeline.STAGES[:-1])
