"""Operators on documents against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from candlewick.llm import byte_bpe, jaccard_join, mpeg_audio, packing, pretokens, quality_rules, secrets, substring_dedup
from candlewick.llm import textops as X
from tests.llm.fixtures import documents, texts, words

RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def by_row(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


@pytest.fixture(scope="module")
def plain():
    tokens = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.Bpe(byte_bpe.read_ranks(RANKS))


def test_byte_bpe(docs, none, plain):
    got = by_row(byte_bpe.byte_bpe(docs, RANKS).collect(), "doc_id", "ids", "decoded")
    want = by_row([{"doc_id": i, "ids": bytearray(np.array(plain.encode_ordinary(t or ""), "<u4").tobytes()), "decoded": bytearray((t or "").encode())} for i, t in texts()], "doc_id", "ids", "decoded")
    assert got == want
    assert byte_bpe.byte_bpe(none, RANKS).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab's tre ll\n\t  'dvm1½é\"日\x1c\xa0　👍")), max_size=14))
def test_split_and_merges_of_any_text(plain, bpe, text):
    part = next(X.slices(pa.array([text])))
    assert pretokens.encode(part, bpe.memo).of(0).tolist() == plain.encode_ordinary(text)


def test_perfect_hash_is_minimal(bpe):
    assert sorted(bpe.hash.slots.tolist()) == list(range(len(bpe.tokens)))
    assert bpe.hash.lookup(bpe.tokens).tolist() == list(range(len(bpe.tokens)))
    assert bpe.hash.lookup([b"not in the vocabulary at all"]).tolist() == [-1]


def test_packing(docs, none):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, t in texts():
        want[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (0,)] += 1
    rows = packing.pack(docs, TOKENIZER).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) // 4
    for (i, n), found in pieces.items():
        times = sum(v for (d, ids), v in want.items() if d == i and len(ids) == n)
        found.sort()
        assert sum(len(p) for _, p in found) == n * times
        for (d, ids), _ in want.items():
            if d == i and len(ids) == n and times == 1:
                assert [x for _, p in found for x in p] == list(ids)
    for found in sequences.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))]
        assert sum(n for _, n in found) <= 1024
    assert sum(want.values()) == sum(1 for r in rows if r.start == 0)
    assert packing.pack(none, TOKENIZER).count() == 0


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "it's<|endoftext|><|endoftext|>  \n x", "<|endoftext", "<|<|endoftext|>|> é日 ", "word " * 1500 + "<|endoftext|> end"]


def packed_ids(docs, path):
    pieces = defaultdict(dict)
    for r in packing.pack(docs, path).collect():
        pieces[r.doc_id, r.doc_tokens][r.start] = np.frombuffer(r.ids, "<u4").tolist()
    return {i: ([x for _, p in sorted(found.items()) for x in p], n) for (i, n), found in pieces.items()}


def test_packing_knows_added_tokens(spark):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(ADDED)}
    assert want[0] == [64, 220, 50256, 275, 0]
    assert packed_ids(documents(spark, list(enumerate(ADDED))), TOKENIZER) == {i: (ids, len(ids)) for i, ids in want.items()}


def test_packing_honours_flags_of_added_tokens(tmp_path):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.add_special_tokens([AddedToken("<sep>", lstrip=True, rstrip=True)])
    tokenizer.add_tokens([AddedToken("qqx", single_word=True, normalized=True)])
    path = str(tmp_path / "flags.json")
    tokenizer.save(path)
    texts = ["a  <sep> \n b", "qqx qqxer sqqx qqx", "no such", None, "", "qqx<sep>qqx<|endoftext|>"]
    found = packing.Tokens(path).with_added(pa.array(texts, pa.string()))
    assert {i: x.tolist() for i, x in found.items()} == {i: tokenizer.encode(texts[i], add_special_tokens=False).ids for i in (0, 1, 5)}
    assert {50257, 50258} <= {x for ids in found.values() for x in ids.tolist()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1023), max_size=80))
def test_windows_hold_every_item_once(sizes):
    found = packing.windows(sizes)
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in w) <= 1024 for w in found)


def test_differencing_is_near_equal():
    sums = sorted(sum([8, 7, 6, 5, 4, 8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4, 8, 7, 6, 5, 4], 3))
    assert sums[-1] - sums[0] <= 2 and sum(sums) == 60


def repetition(text):
    text, own = text or "", words(text)
    out = {"n_words": len(own), "word_chars": sum(len(w.decode()) for w in own), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    seen, out["n_dup_lines"] = set(), 0
    for line in text.split("\n"):
        if words(line):
            out["n_dup_lines"] += line in seen
            seen.add(line)
    grams = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    often = Counter(grams)
    out["n_repeat_words"] = len({i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)})
    for n in quality_rules.LIMITS:
        before, inside = set(), set()
        for i in range(len(own) - n + 1):
            g = tuple(own[i : i + n])
            inside |= set(range(i, i + n)) if g in before else set()
            before.add(g)
        out[f"gram_{n}_chars"] = sum(len(own[i].decode()) for i in inside)
    return out


def test_quality_rules(docs, none):
    rows = quality_rules.quality_rules(docs).collect()
    names = ["doc_id", *repetition("")]
    assert by_row(rows, *names) == by_row([{"doc_id": i, **repetition(t)} for i, t in texts()], *names)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        over = r.line_chars > 0.3 * r.word_chars or any(r[f"gram_{k}_chars"] > v * r.word_chars for k, v in quality_rules.LIMITS.items())
        assert r.kept == (not r.base_failed and not over)
    carried = quality_rules.quality_rules(docs, carry=tuple(docs.columns))
    assert set(carried.columns) >= set(docs.columns) and carried.count() == len(texts())
    assert quality_rules.quality_rules(none).count() == 0


def test_substring_dedup(docs, none):
    first = {}
    for i, t in texts():
        own = words(t)
        for k in range(len(own) - 12):
            g = tuple(own[k : k + 13])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    want = []
    for i, t in texts():
        own, gone = words(t), set()
        for k in range(len(own) - 12):
            if i is not None and first[tuple(own[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        want.append({"doc_id": i, "n_words": len(own), "n_removed": len(gone), "kept": b" ".join(w for j, w in enumerate(own) if j not in gone).decode()})
    found = substring_dedup.substring_dedup(docs)
    assert by_row(found.collect(), "doc_id", "n_words", "n_removed", "kept") == by_row(want, "doc_id", "n_words", "n_removed", "kept")
    assert sum(r["n_removed"] for r in want) > 500
    assert substring_dedup.substring_dedup(none).count() == 0


def classes(rows, percent=80):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets, parent = [], {}
    for i, t in rows:
        own = [w.translate(lower) for w in words(t)]
        sets.append((i, {tuple(own[k : k + 5]) for k in range(len(own) - 4)} if len(own) > 4 else {tuple(own)} if own else set()))
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, s) in enumerate(sets):
        for j, u in sets[:x]:
            if i is not None and j is not None and s and 100 * len(s & u) >= percent * len(s | u):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [{"doc_id": i, "n_shingles": len(s), "component_id": None if i is None else root(i)} for i, s in sets]


@pytest.mark.parametrize("block", [256, 4])
def test_jaccard_join(docs, none, block):
    found = jaccard_join.jaccard_join(docs, block=block)
    assert by_row(found.collect(), "doc_id", "n_shingles", "component_id") == by_row(classes(texts()), "doc_id", "n_shingles", "component_id")
    if block == 4:
        assert jaccard_join.jaccard_join(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=9, unique=True).map(sorted), max_size=9), st.integers(1, 6))
def test_divide_skip_counts_every_member(lists, need):
    counts = Counter(x for one in lists for x in one)
    found = dict(jaccard_join.divide_skip(sorted(lists, key=len), need, lambda c: False))
    assert found == {c: n for c, n in counts.items() if n >= need}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASE = (("assign", ASSIGN, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))


def test_secrets(docs, none):
    rows = secrets.scan(docs.select("doc_id", "text", "spans")).collect()
    assert len(rows) == len(texts())
    for r in rows:
        want = sorted((m.start(), k, m.end(), name) for k, (name, p, f) in enumerate(BASE) for m in p.finditer(r.text or "") if f(m))
        assert [tuple(s) for s in r.base_spans] == want
        assert set(map(tuple, r.spans)) >= set(want)
    assert secrets.scan(none).count() == 0


def test_random_strings_are_told_from_ordinary_ones(spark):
    r = random.Random(5)
    stems = ["transform", "column", "schema", "partition", "reader", "config", "default", "handler", "session", "builder"]
    ordinary = ["_".join(r.choices(stems, k=3)) for _ in range(400)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    drawn = lambda: "".join(r.choices(letters, k=32))
    unseen, plain = drawn(), "session_partition_builder_default"
    rows = [(i, f"call {w} with token={drawn()} now") for i, w in enumerate(ordinary)] + [(900, f"left {unseen} here"), (901, f"call {plain} again")]
    found = {x.doc_id: [x.text[s.start : s.end] for s in x.spans if s.kind == "random"] for x in secrets.scan(documents(spark, rows)).collect()}
    assert found[900] == [unseen] and sum(map(len, found.values())) == 1
    redacted = {x.doc_id: x.text for x in secrets.redacted(documents(spark, rows)).collect()}
    assert redacted[900] == "left [SECRET] here" and redacted[901] == f"call {plain} again"


@pytest.mark.parametrize("times", [1, 100])
def test_random_strings_are_found_at_any_size(spark, times):
    r = random.Random(5)
    stems = ["transform", "column", "schema", "partition", "reader", "config", "default", "handler", "session", "builder"]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    drawn = lambda alphabet: "".join(r.choices(alphabet, k=32))
    unseen = [drawn(letters) for _ in range(60 * times)] + [drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(6 * times)]
    texts = [f"call {'_'.join(r.choices(stems, k=3))} now" for _ in range(300 * times)] + [f"token={drawn(letters)}" for _ in range(100 * times)] + [f"left {x} here" for x in unseen]
    rows = secrets.scan(documents(spark, list(enumerate(texts)))).selectExpr("text", "filter(spans, x -> x.kind = 'random') as found").where("size(found) > 0").collect()
    assert Counter(r.text[s.start : s.end] for r in rows for s in r.found) == Counter(unseen)


def test_redaction(docs):
    found = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert found[123] == "é😀 [SECRET] 😀 [SECRET] apikey=1 TOKEN=token:abcdefg".replace("TOKEN=token:abcdefg", found[123].rsplit(" ", 1)[1])
    assert "hunter22" not in found[123] and "0123456789abcdef" not in found[122]
    assert found[113] is None and found[116] == "one"


def plain_random(text: str, base: list[tuple], weight: dict[int, float]) -> list[tuple]:
    """The random strings of a text by a plain loop over candidates, base spans and transitions."""
    found = []
    for m in re.finditer(secrets.CANDIDATE, text):
        if not any(m.start() < e and s < m.end() for s, _, e, _ in base):
            codes = [secrets.LETTERS.index(c) + 1 for c in m[0]]
            if sum(weight[a * secrets.CODES + b] for a, b in zip(codes, codes[1:], strict=False)) >= secrets.LEAST_EVIDENCE:
                found.append((m.start(), 3, m.end(), "random"))
    return found


def long_texts(n: int, seed: int = 7) -> list[str]:
    """Texts with n secrets, strings that overlap base spans at their ends, and words."""
    r = random.Random(seed)
    letters = secrets.LETTERS[:62]
    string = lambda k: "".join(r.choices(letters, k=k))
    parts = [lambda: f"é password = {string(12)}", lambda: f"{string(30)}token={string(r.randint(3, 30))}", lambda: string(76), lambda: "AKIA" + "A" * 20 + string(9), lambda: "0123456789abcdef" * 2 + "/" + string(40), lambda: "some_ordinary_identifier_of_code", lambda: f"api_key: {string(5)}-{string(30)}", lambda: "words 日 of prose"]
    return ["\n".join(r.choice(parts)() for _ in range(n)), " ".join(string(76) for _ in range(n)), "x".join(f'é secret="{string(9)}"' for _ in range(n)), string(70_000 + n)]


def test_secrets_of_long_texts(spark):
    """Blocks and pieces of scans don't show: spans and redaction are those of plain loops."""
    rows = list(enumerate(long_texts(900)))
    frame = documents(spark, rows)
    weight = {r["code"]: float(f"{r['weight']:.4f}") for r in secrets.model(frame).collect()}
    redacted = {r.doc_id: r.text for r in secrets.redacted(frame).collect()}
    for r in secrets.scan(frame).collect():
        text = dict(rows)[r.doc_id]
        base = sorted((m.start(), k, m.end(), name) for k, (name, p, f) in enumerate(BASE) for m in p.finditer(text) if f(m))
        spans = sorted(base + plain_random(text, base, weight))
        assert [tuple(s) for s in r.base_spans] == base and [tuple(s) for s in r.spans] == spans
        out, at = [], 0
        for s, _, e, _ in spans:
            if s >= at:
                out += [text[at:s], "[SECRET]"]
            at = max(at, e)
        assert redacted[r.doc_id] == "".join(out) + text[at:]


def test_time_of_secrets_is_in_proportion_to_the_text(spark):
    import time

    took = []
    for n in (1_000, 4_000, 16_000):  # up to 1.2 MB of base64 lines
        frame = documents(spark, list(enumerate(long_texts(n)[1:3])), 1).cache()
        frame.count()
        began = time.time()
        assert secrets.redacted(frame).agg(F.sum(F.length("text"))).first()[0]
        took.append(time.time() - began)
    print("seconds of 1000, 4000, 16000 lines:", [round(x, 1) for x in took])
    assert took[2] - took[0] < 10 * max(1, took[1] - took[0])


def test_mpeg_audio(docs, none):
    stored = mpeg_audio.store_audio(docs)
    found = mpeg_audio.read_audio(stored).collect()
    want = Counter((i, mpeg_audio.padded((t or "").encode())) for i, t in texts())
    assert Counter((r.doc_id, bytes(r.payload)) for r in found) == want
    for r in found:
        assert r.crc_bad == 0 and r.crc_checked == len(r.frame_offsets) == r.told_frames and r.samples == 1152 * r.told_frames
        assert all(mpeg_audio.header(bytes(r.media[o : o + 4])) for o in r.frame_offsets)
    assert mpeg_audio.read_audio(mpeg_audio.store_audio(none)).count() == 0


def test_damaged_audio():
    whole = mpeg_audio.store(mpeg_audio.padded(b"x" * 9000))
    plain = mpeg_audio.read(whole)
    moved = mpeg_audio.read(b"junk \xff\xfb\x90" + whole[plain.offsets[0] : plain.offsets[2]] + b"more\xffjunk" + whole[plain.offsets[2] :])
    assert len(moved.offsets) == len(plain.offsets) and moved.resyncs == 2 and moved.skipped == 17 and moved.payload == plain.payload + moved.payload[len(plain.payload) :]
    hurt = bytearray(whole)
    hurt[plain.offsets[1] + 8] ^= 1
    assert mpeg_audio.read(bytes(hurt)).bad == 1
    tagged = mpeg_audio.read(whole + b"TAG" + b"title".ljust(125, b"\0"))
    assert tagged.tags["TIT2"] == "title" and tagged.skipped == 0
    assert mpeg_audio.read(b"").samples == 0 and mpeg_audio.read(b"\xff" * 50).offsets == []
    assert mpeg_audio.crc16(b"123456789") == 0xAEE7


@pytest.mark.parametrize("size", [192, 1344, 1536, 2880])
def test_a_payload_with_the_name_of_a_tag_stays_whole(size):
    stored = mpeg_audio.store(bytes(size))
    for at in range(size - 2):
        payload = b"." * at + b"TAG" + b"." * (size - 3 - at)
        media = mpeg_audio.store(payload)
        found = mpeg_audio.read(media)
        assert (found.payload, found.skipped, found.resyncs, set(found.tags)) == (payload, 0, 0, {"TLEN", "payload_bytes"})
        assert len(found.payload) == int(found.tags["payload_bytes"]) and len(media) == len(stored)
        if media[-128:-125] == b"TAG":
            tagged = mpeg_audio.read(media + b"TAG" + b"title".ljust(125, b"\0"))
            assert (tagged.payload, tagged.tags["TIT2"], tagged.skipped) == (payload, "title", 0)
    cut = mpeg_audio.read(stored[:-40] + b"TAG" + b"title".ljust(125, b"\0"))
    assert cut.tags["TIT2"] == "title" and len(cut.payload) < size


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=40), st.sampled_from([b"TAG", b"ID3\x03\0", b"Xing", b"VBRI", b"Info", b"\xff", b"\xff\xfb\x90\xc0", b"\xff\xfa\x18\xc0"]), st.integers(0, 1500).map(bytes)), max_size=12))
def test_any_payload_is_read_back(parts):
    payload = mpeg_audio.padded(b"".join(parts))
    found = mpeg_audio.read(mpeg_audio.store(payload))
    assert found.payload == payload and found.bad == found.skipped == found.resyncs == 0 and found.table == "Xing"


def test_precision_and_recall_of_random_strings(spark):
    """Planted random strings of several alphabets among ordinary long ones."""
    r = random.Random(9)
    stems = ["transform", "column", "schema", "partition", "reader", "config", "default", "handler", "session", "builder", "Utils", "Http", "Request", "index", "page", "user"]
    alphabets = {"base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "letters and digits": "abcdefghijklmnopqrstuvwxyz0123456789"}
    ordinary = lambda: r.choice([lambda: "_".join(r.choices(stems, k=4)), lambda: "".join(x.capitalize() for x in r.choices(stems, k=4)), lambda: "/".join(["src", *r.choices(stems, k=4)]), lambda: "-".join(r.choices(stems, k=3)) + f"-20{r.randint(10, 30)}-0{r.randint(1, 9)}"])()
    planted = [("".join(r.choices(a, k=r.randint(24, 44)))) for a in alphabets.values() for _ in range(100)]
    rows = [f"see {ordinary()} and {ordinary()} for it" for _ in range(1500)] + [f"key {x} is here" for x in planted] + [f"token={''.join(r.choices(alphabets['base64'], k=32))}" for _ in range(100)]
    found = secrets.scan(documents(spark, list(enumerate(rows)))).selectExpr("text", "filter(spans, x -> x.kind = 'random') as found").where("size(found) > 0").collect()
    got = {x.text[y.start : y.end] for x in found for y in x.found}
    recall, precision = len(got & set(planted)) / len(planted), len(got & set(planted)) / max(1, len(got))
    print(f"random strings: recall {recall:.3f}, precision {precision:.3f}")
    assert recall > 0.95 and precision > 0.95


CLASHES = [
    "apart", "base_spans", "spans", "n_words", "n_removed", "kept", "n_shingles", "component_id", "component", "id", "tokens", "key", "chunk", "blob", "bits", "c0", "C1", "_measured", "base_failed", "label", "fold", "score", "held_out",
    "ids", "decoded", "media", "payload", "n_bytes", "start", "length", "offset", "sequence_id", "doc_tokens", "p_toxic", "is_toxic", "row", "_row",
]


def test_no_name_of_a_column_clashes(spark):
    from candlewick.llm import quality_knn, toxicity

    data = [(i, t, *CLASHES) for i, t in texts()]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3).cache()
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id bigint, quality int, toxic int")
    replaced = {"n_words", "n_removed", "kept"}
    for found in (byte_bpe.byte_bpe(docs, RANKS), quality_rules.quality_rules(docs), jaccard_join.jaccard_join(docs), mpeg_audio.store_audio(docs), toxicity.toxicity(docs, labels), quality_knn.quality_knn(docs, labels), packing.pack(docs, TOKENIZER)):
        assert found.count() >= len(data)
    for found in (substring_dedup.trimmed(docs), secrets.redacted(docs)):
        assert found.columns == docs.columns and [tuple(x) for x in found.select(*(f"`{c}`" for c in CLASHES)).distinct().collect()] == [tuple(CLASHES)]
    found = substring_dedup.substring_dedup(docs)
    assert {c for c in CLASHES if c not in replaced} <= set(found.columns) and found.count() == len(data)
    found = secrets.scan(docs)
    assert found.where("apart = 'apart' and `C1` = 'C1'").count() == len(data) and dict(found.dtypes)["spans"].startswith("array")
    assert mpeg_audio.read_audio(mpeg_audio.store_audio(docs).join(docs.select("doc_id", "score", "tokens"), "doc_id")).where("score = 'score'").count() > 0
