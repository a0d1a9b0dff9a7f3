"""Each registered query, run by name over a small folder of tables, against libraries, plain loops or SQL."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__
from candlewick.llm import byte_bpe, mpeg_audio
from tests.llm.fixtures import texts
from tests.llm.test_documents import BASE

QUERIES = __spark_entry__.queries()


def rows_with_ids() -> list[tuple[int, str | None]]:
    """The texts, with ids of their own, and one with an added token."""
    return [*((i, t) for i, (_, t) in enumerate(texts())), (1000, "hi <|endoftext|> there")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows_with_ids()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 1)) for i in range(100)], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    urls = ["http://a.org/x", "https://www.b.com/de/y?z", "http://c.net/en/1", None, "no scheme", "http://sub.EXAMPLE.org/es/q"]
    spark.createDataFrame([(i, u, "<html>") for i, u in enumerate(urls)], "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


def test_op1(spark, folder):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    ids = {i: plain.encode_ordinary(t or "") for i, t in rows_with_ids()}
    want = {i: (len(x), sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in ids.items()}
    found = QUERIES["op1_byte_bpe"](spark, folder).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in found} == want
    assert {r.doc_id: r.decoded_sha256 for r in found} == {i: sha256((t or "").encode()).hexdigest() for i, t in rows_with_ids()}


def test_op2(spark, folder):
    for r in QUERIES["op2_secrets"](spark, folder).collect():
        text = dict(rows_with_ids())[r.doc_id] or ""
        want = sorted((m.start(), k, m.end(), name) for k, (name, p, f) in enumerate(BASE) for m in p.finditer(text) if f(m))
        joined = ",".join(f"{name}:{a}:{b}" for a, _, b, name in want)
        assert r.base_sha256 == sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= {*r.spans.split(","), ""}
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[3] == kind for x in want) for kind in ("assign", "access", "hex")]


@pytest.mark.parametrize("name", ["op4_quality_rules", "op8_jaccard_join", "op10_substring_dedup"])
def test_queries_with_sql(spark, folder, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet' WHERE doc_id <> {[i for i, t in rows_with_ids() if t and len(t) > 100_000][0]}")
    found = QUERIES[name](spark, folder)
    made = db.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in made.description]
    want = {tuple(r[names.index(c)] for c in sorted(names)) for r in made.fetchall()}
    got = {tuple(r[c] for c in sorted(names)) for r in found.collect()}
    assert sorted(found.columns) == sorted(names) and want <= got and len(got) == len(want) + 1


def test_op3_and_op5(spark, folder):
    toxic, quality = QUERIES["op3_toxicity"](spark, folder).collect(), QUERIES["op5_quality_knn"](spark, folder).collect()
    assert len(toxic) == len(quality) == len(rows_with_ids())
    for r in quality:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    same = defaultdict(set)
    for r in quality:
        same[dict(rows_with_ids())[r.doc_id] or ""].add(r.score)
    assert all(len(x) == 1 for x in same.values())


def test_op6(spark, folder):
    for r in QUERIES["op6_mpeg_audio"](spark, folder).collect():
        raw = (dict(rows_with_ids())[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        media = mpeg_audio.store(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), sha256(media).hexdigest()) and re.match(r"mpeg1-layer3;rate=32000;frames=\d+;", r.feature)


def test_op7(spark, folder):
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in QUERIES["op7_url_filter"](spark, folder).collect()}
    assert found[0] == ("a.org", "/x", "org/", "allow") and found[1] == ("www.b.com", "/de/y", "com/de/", "block") and found[5] == ("sub.example.org", "/es/q", "example.org/es/", "block")
    assert found[2][:3] == ("c.net", "/en/1", None) and found[3][:3] == found[4][:3] == ("", "", None) and {x[3] for x in found.values()} <= {"allow", "block"}


@pytest.mark.parametrize("name", ["op9_packing", "pipeline"])
def test_pieces(spark, folder, name):
    found = QUERIES[name](spark, folder).collect()
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    if name == "op9_packing":
        library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        pieces = defaultdict(list)
        for r in found:
            pieces[r.doc_id].append(r)
        for i, t in rows_with_ids():
            ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 0], 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids)
        assert 50256 in library.encode("hi <|endoftext|> there", add_special_tokens=False).ids
    assert max(Counter(r.sequence_id for r in found).values()) > 1
