"""Secret scans with DataFrame functions only: fixed patterns, and Markov models of random and ordinary strings."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.chunks import number_of, numbered, restored

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

#: Strings that the models judge, and ordinary strings that train them.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{12,}"
#: Of the latter, those that are judged too and may be random train no model: a digit, a small letter and a capital, or three borders of letter and digit.
JUDGED, MIXED = 20, r"^(?:(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])|(?:.*?(?:[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z]))){3})"
#: Characters of candidates; a model is a table of the transitions from each to each.
LETTERS = string.ascii_letters + string.digits + "+/_=-"
CODES = len(LETTERS) + 1
#: A candidate is a secret if random strings explain it better by so many nats: a secret is that much rarer beforehand.
LEAST_EVIDENCE = 12.0
#: Shares of all transitions: seen after a character, so many weigh as much as how frequent the next one is anywhere; and
#: what is added to each single character. Shares, so that the size of the input doesn't matter.
BACKOFF, FLOOR = 0.1, 0.0001

KINDS = ("assign", "access", "hex", "random")
_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"
_TEXT_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,text:string>"
#: Items that a scan takes at once, and characters of a string that are taken apart at once: the work stays in proportion to the text.
BLOCK, PIECE = 256, 1 << 16


def _value(match: Column) -> Column:
    """The value of an assignment that was matched."""
    return F.regexp_extract(match, ASSIGN, 2)


def _may_assign(text: Column) -> Column:
    return F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: in a lambda function an expression is computed wherever it stands."""
    return F.transform(F.array(value), use)[0]


def scanned(items: Column, zero: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]], kind: str) -> Column:
    """An array scanned with a state: the final state's fields, and ``out``, all that step(state, item) gives besides a new state, in order.

    step gives arrays of the SQL type kind. Adding to an array copies it, so items are taken BLOCK by BLOCK: what a block
    gives is added to its own array, and the arrays of blocks, a reference each, to the result's.
    """
    none = F.array().cast(f"array<{kind}>")

    def inner(s: Column, x: Column) -> Column:
        state, given = step(s, x)
        return F.struct(*(v.alias(n) for n, v in state.items()), F.concat(s["out"], given).alias("out"))

    def outer(s: Column, block: Column) -> Column:
        own = F.aggregate(block, F.struct(*(s[n].alias(n) for n in zero), none.alias("out")), inner)
        return _let(own, lambda now: F.struct(*(now[n].alias(n) for n in zero), F.concat(s["out"], F.array(now["out"])).alias("out")))

    first = F.struct(*(v.alias(n) for n, v in zero.items()), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(_blocks(items), first, outer, lambda s: F.struct(*(s[n].alias(n) for n in zero), F.flatten(s["out"]).alias("out")))


def _blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK items; one empty one for an empty array."""
    starts = lambda own: F.sequence(F.lit(0), F.floor((F.greatest(F.size(own), F.lit(1)) - 1) / BLOCK).cast("int"))
    return _let(items, lambda own: F.transform(starts(own), lambda i: F.slice(own, i * BLOCK + 1, F.lit(BLOCK))))


def _matches(text: Column, pattern: str, kind: str, possible: Column, keep=None, with_text: bool = False) -> Column:
    """The spans of a pattern's matches, leftmost first and not overlapping, from the lengths of what lies between them.

    keep(match): whether it stays. with_text: spans have the match as text.
    """
    whole, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(whole.alias("m"), F.slice(between, F.lit(1), F.size(whole)).alias("b"))
    type_ = _TEXT_SPAN if with_text else _SPAN

    def step(s: Column, x: Column) -> tuple[dict[str, Column], Column]:
        start = s["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), *([x["m"].alias("text")] if with_text else [])))
        return {"at": end}, F.when(keep(x["m"]), span).otherwise(F.array().cast(f"array<{type_}>")) if keep else span

    return F.when(possible, scanned(pairs, {"at": F.lit(0).cast("bigint")}, step, type_)["out"]).otherwise(F.array().cast(f"array<{type_}>"))


def _apart(candidates: Column, base: Column) -> Column:
    """Of candidates, which don't overlap each other, those that overlap none of the base spans: one pass over both by start.

    A candidate is held until the next one comes: a base span before it that reaches over its start, or one that starts
    before its end, rules it out.
    """
    place = lambda x, other, text: F.struct(x["start"].alias("start"), F.lit(other).alias("other"), x["end"].alias("end"), x["rank"].alias("rank"), x["kind"].alias("kind"), text.alias("text"))
    every = F.array_sort(F.concat(F.transform(base, lambda x: place(x, 0, F.lit(""))), F.transform(candidates, lambda x: place(x, 1, x["text"]))))
    nothing, none = F.lit(None).cast(_TEXT_SPAN), F.array().cast(f"array<{_TEXT_SPAN}>")

    def step(s: Column, x: Column) -> tuple[dict[str, Column], Column]:
        own = F.struct(*(x[n].alias(n) for n in ("start", "rank", "end", "kind", "text")))
        ruled_out = F.when(x["start"] < s["held"]["end"], nothing).otherwise(s["held"])
        held = F.when(x["other"] == 0, ruled_out).when(x["start"] < s["reach"], nothing).otherwise(own)
        reach = F.when(x["other"] == 0, F.greatest(s["reach"], x["end"])).otherwise(s["reach"])
        return {"reach": reach, "held": held}, F.when((x["other"] == 1) & s["held"].isNotNull(), F.array(s["held"])).otherwise(none)

    found = scanned(every, {"reach": F.lit(0).cast("bigint"), "held": nothing}, step, _TEXT_SPAN)
    return _let(found, lambda f: F.when(f["held"].isNotNull(), F.concat(f["out"], F.array(f["held"]))).otherwise(f["out"]))


def _base(text: Column) -> list[Column]:
    return [
        _matches(text, ASSIGN, "assign", _may_assign(text) & text.rlike(ASSIGN), lambda m: F.length(_value(m)) >= LEAST_VALUE),
        _matches(text, ACCESS, "access", F.contains(text, F.lit("AKIA"))),
        _matches(text, HEX, "hex", text.rlike(HEX)),
    ]


def _letter(c: Column) -> Column:
    """The number of a character of LETTERS, from 1, else 0."""
    return F.instr(F.lit(LETTERS), c)


def _pieces(s: Column) -> Column:
    """A string in pieces that overlap in one character."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1)), F.lit(PIECE)), lambda i: F.substring(s, i, F.lit(PIECE + 1)))


def _codes(piece: Column) -> Column:
    """The transitions of a piece."""
    chars = F.transform(F.split(piece, ""), _letter)
    return F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda a, b: a * CODES + b)


def model(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Columns code, weight: for each transition the logarithm of its probability in random over that in ordinary strings.

    Random samples are the values that the base patterns find, ordinary ones the strings of 12 characters or more that
    are left without these, in all texts, but for strings of 20 or more of mixed classes: they are judged, and would make
    themselves ordinary. Transitions are mixed with the frequencies of single characters in a share of all transitions, so a
    character that ordinary strings seldom have counts wherever it stands, however many texts there are. One more of each
    keeps an empty table uniform. The table's size is fixed.
    """
    text = F.coalesce(text_col, F.lit(""))
    values = F.when(_may_assign(text), F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= LEAST_VALUE)).otherwise(F.array().cast("array<string>"))
    found = F.concat(values, F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))
    rest = F.when(_may_assign(text), F.regexp_replace(text, ASSIGN, " ")).otherwise(text)
    rest = F.regexp_replace(F.when(F.contains(rest, F.lit("AKIA")), F.regexp_replace(rest, ACCESS, " ")).otherwise(rest), HEX, " ")
    ordinary = F.filter(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0)), lambda x: (F.length(x) < JUDGED) | ~x.rlike(MIXED))
    label = lambda strings, random: F.transform(strings, lambda x: F.struct(F.lit(random).alias("random"), x.alias("s")))
    strings = docs.select(F.explode(F.concat(label(found, True), label(ordinary, False))).alias("x")).select("x.random", "x.s").where(F.length("s") > 1)
    pieces = strings.select("random", F.explode(_pieces(F.col("s"))).alias("piece"))
    steps = pieces.select("random", F.explode(_codes(F.col("piece"))).alias("code"))
    counts = steps.groupBy("code").agg(F.count_if("random").alias("random"), F.count_if(~F.col("random")).alias("ordinary"))
    grid = docs.sparkSession.range(0, CODES * CODES, 1, 1).withColumnRenamed("id", "code").join(counts, "code", "left").na.fill(0)
    grid = grid.withColumns({"before": F.floor(F.col("code") / CODES), "after": F.col("code") % CODES})
    over = {"before": Window.partitionBy("before"), "after": Window.partitionBy("after"), "all": Window.partitionBy(F.lit(1))}  # of a table of fixed size

    def probability(n: str) -> Column:
        total = F.sum(n).over(over["all"])
        added, weight = 1 + FLOOR * total, 1 + BACKOFF * total
        one = (F.sum(n).over(over["after"]) + added) / (total + len(LETTERS) * added)
        return (F.col(n) + weight * one) / (F.sum(n).over(over["before"]) + weight)

    return grid.select("code", (F.ln(probability("random")) - F.ln(probability("ordinary"))).alias("weight"))


def _table(weights: DataFrame) -> Column:
    """A model as an array that all tasks have: CODES ** 2 numbers, whatever the size of the input."""
    numbers = {r["code"]: r["weight"] for r in weights.collect()}
    return F.split(F.lit(",".join(f"{numbers[i]:.4f}" for i in range(CODES * CODES))), ",").cast("array<double>")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs with ``base_spans`` and ``spans``: arrays of start, rank, end, kind, by start and then kind.

    Starts and ends count code points, ends are exclusive. ``base_spans`` are those of the fixed patterns; an assignment
    with a value of fewer than 6 characters is left out. ``spans`` has these and, as kind random, the strings of 20
    characters or more that overlap none of them and that the models of ``model`` take for random. Null and empty texts
    have no spans; texts are scanned whole, of any length, in time in proportion to it; rows aren't told apart, so repeated
    ones have equal spans. Other columns stay, whatever their names; columns of these two names are replaced. The text is
    read twice, with no shuffle of texts: first for the counts of the models.
    """
    docs = docs.drop(*(n for n in docs.columns if n.lower() in ("base_spans", "spans") and n != text_col))
    own, name = numbered(docs), number_of(docs, text_col)
    text = F.coalesce(F.col(name), F.lit(""))
    weights = _table(model(own, name))
    based = own.select("*", F.array_sort(F.concat(*_base(text))).alias("base"))
    candidates = based.select("*", _matches(text, CANDIDATE, "random", text.rlike(CANDIDATE), with_text=True).alias("candidates"))
    brought = candidates.select(*own.columns, "base", F.when((F.size("candidates") > 0) & (F.size("base") > 0), _apart(F.col("candidates"), F.col("base"))).otherwise(F.col("candidates")).alias("apart"))

    def evidence(s: Column, table: Column) -> Column:
        return F.aggregate(_pieces(s), F.lit(0.0), lambda total, piece: F.aggregate(_codes(piece), total, lambda t, c: t + F.get(table, c)))

    secret = F.filter("apart", lambda x: evidence(x["text"], weights) >= LEAST_EVIDENCE)
    random = F.when(F.size("apart") > 0, F.transform(secret, lambda x: F.struct(*(x[n].alias(n) for n in ("start", "rank", "end", "kind"))))).otherwise(F.array().cast(f"array<{_SPAN}>"))
    found = brought.select(*own.columns, "base", F.array_sort(F.concat("base", random)).alias("all"))
    return found.toDF(*docs.columns, "base_spans", "spans")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret of the text replaced by a mark; overlapping spans get one. Other columns stay, whatever their names.

    Spans are taken BLOCK by BLOCK: a block's stretch is cut from the text, what lies between its spans from that stretch.
    """
    own, name = numbered(docs), number_of(docs, text_col)
    text = F.col(name)
    from_, n = (lambda s, at: F.substring(s, at.cast("int") + 1, F.lit((1 << 31) - 1))), (lambda x: x.cast("int"))

    def block(s: Column, spans: Column) -> Column:
        reach = F.greatest(s["at"], F.array_max(F.transform(spans, lambda x: x["end"])))
        stretch = F.substring(text, n(s["at"]) + 1, n(reach - s["at"]))

        def step(t: Column, x: Column) -> Column:
            before = F.substring(t["stretch"], n(t["at"] - t["from"]) + 1, n(F.greatest(x["start"] - t["at"], F.lit(0))))
            parts = F.when(x["start"] >= t["at"], F.concat(t["parts"], F.array(before, F.lit(mark)))).otherwise(t["parts"])
            return F.struct(F.greatest(t["at"], x["end"]).alias("at"), t["from"].alias("from"), t["stretch"].alias("stretch"), parts.alias("parts"))

        first = F.struct(s["at"].alias("at"), s["at"].alias("from"), stretch.alias("stretch"), F.array().cast("array<string>").alias("parts"))
        return _let(F.aggregate(spans, first, step), lambda t: F.struct(t["at"].alias("at"), F.concat(s["parts"], F.array(F.array_join(t["parts"], ""))).alias("parts")))

    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    clean = F.aggregate(_blocks(F.col("spans")), state, block, lambda s: F.concat(F.array_join(s["parts"], ""), from_(text, s["at"])))
    return restored(scan(own, name).withColumn(name, F.when(F.size("spans") > 0, clean).otherwise(text)), docs)
