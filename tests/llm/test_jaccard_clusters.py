"""Large clusters with few links: documents made of paragraphs from one pool."""

from __future__ import annotations

import random

import numpy as np
import pytest

from candlewick.llm import jaccard_join


def from_pool(n: int, seed: int = 3, paragraphs: int | None = None) -> list[tuple[int, str]]:
    """n documents of five paragraphs of a pool, each in some forty documents; one in ten is another with a word changed."""
    r = random.Random(seed)
    pool = [" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for _ in range(paragraphs or n // 8)]
    rows: list[tuple[int, str]] = []
    for i in range(n):
        if i > 20 and i % 10 == 0:
            words = rows[r.randrange(len(rows))][1].split(" ")
            words[r.choice([0, 1, -1, -2])] = f"x{i}"
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(r.sample(pool, 5))))
    r.shuffle(rows)
    return rows


def classes(rows: list[tuple[int, str]], percent: int = 80) -> dict[int, int]:
    """Component of each document, from the overlaps of all pairs."""
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split(" ")]}
    ids = sorted(sets)
    number: dict[tuple, int] = {}
    holders: dict[int, list[int]] = {}
    for at, i in enumerate(ids):
        for s in sets[i]:
            holders.setdefault(number.setdefault(s, len(number)), []).append(at)
    shared = [x for x in holders.values() if len(x) > 1]
    table = np.zeros((len(ids), len(shared)), np.float32)
    for column, x in enumerate(shared):
        table[x, column] = 1
    size = np.array([len(sets[i]) for i in ids])
    component = list(range(len(ids)))

    def root(i: int) -> int:
        while component[i] != i:
            i = component[i]
        return i

    common = (table @ table.T).astype(int)
    for a, b in np.argwhere(np.triu(100 * common >= percent * (size[:, None] + size[None] - common), 1)).tolist():
        x, y = sorted((root(a), root(b)))
        component[y] = x
    return {i: ids[root(at)] for at, i in enumerate(ids)}


def joined(spark, rows, block: int) -> dict[int, int]:
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    return {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(docs, block=block).collect()}


@pytest.fixture
def counted(monkeypatch):
    """Rows of the written tables of a name, summed up."""
    rows: dict[str, int] = {}
    write = jaccard_join.C.written

    def written(df, name):
        found = write(df, name)
        if name in ("asked", "open"):
            rows[name] = rows.get(name, 0) + found.count()
        return found

    monkeypatch.setattr(jaccard_join.C, "written", written)
    return rows


def test_a_cluster_without_links_to_its_pivots(spark, counted):
    """Equal to all pairs; sets meet the blocks that share a shingle, so twice the documents ask twice the blocks, not four times."""
    asked = []
    for n in (1500, 3000):
        rows = from_pool(n)
        counted.clear()
        assert joined(spark, rows, 32) == classes(rows)
        assert counted["open"] > n // 2
        asked.append(counted["asked"])
        assert counted["asked"] < counted["open"] * (n // 32) / 2
    assert asked[1] < 2.2 * asked[0]


@pytest.mark.parametrize("paragraphs", [7, 40])
def test_shingles_in_all_blocks(spark, paragraphs):
    rows = from_pool(600, seed=paragraphs, paragraphs=paragraphs)
    assert joined(spark, rows, 16) == classes(rows)
