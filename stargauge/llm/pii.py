"""Personal data by bootstrapped contextual extraction.

Plain patterns of four kinds find the seeds. The words around seeds are lexical patterns; an
identifier-like string that no plain pattern accepts is an instance of a kind if it stands in
patterns in which seeds of that kind, and hardly anything else, stand. Patterns and instances form a
graph, whose scores Spark computes round by round: promoted instances strengthen their patterns,
which may promote further instances.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargauge.llm.common import small_batches
from stargauge.sources.staging import stage

KINDS = ("email", "ip", "card", "phone")

# The plain patterns, anchored so that a failing run of characters is read once.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"[\[({] ?at ?[\])}]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# What may be an instance though no plain pattern accepts it, by kind.
_SHAPES = {
    # a name and a host, with the sign written out or without a dot
    "email": re.compile(
        r"(?<![^\s<(\"'])[A-Za-z0-9._%+-]{1,64}(?:@| ?[\[({] ?at ?[\])}] ?)[A-Za-z0-9-]{2,63}"
        r"(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]{2,63}){0,5}(?![^\s>,.;:!?)\"'])"
    ),
    # hexadecimal parts with colons, or four numbers of which one is too great
    "ip": re.compile(
        r"(?<![0-9A-Za-z.:])(?:[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}|[0-9]{1,3}(?:\.[0-9]{1,3}){3})"
        r"(?![0-9A-Za-z:])"
    ),
    # as many digits as a card has, whatever their check digit
    "card": re.compile(r"(?<![0-9A-Za-z+])[0-9](?:[ -]?[0-9]){11,18}(?![0-9A-Za-z])"),
    # digits and signs of a number without its country
    "phone": re.compile(
        r"(?<![0-9A-Za-z+.])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,13}(?![0-9A-Za-z]|[.-][0-9])"
    ),
}

# Characters around a span in which its neighbouring words are looked for.
CONTEXT = 64
ROUNDS = 3
# A pattern needs this many different instances of a kind, and an instance this score.
LEAST_INSTANCES = 3
PROMOTED = 0.7
# Scores are whole numbers of this size, so that sums do not depend on their order.
UNIT = 1_000_000

_CANDIDATE = "struct<kind:string,start:int,end:int,base:boolean,value:string,sides:array<string>>"


# ---- plain patterns -----------------------------------------------------------------------


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for match in _DOMAIN.finditer(text):
        at = start = match.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = match.end()
            yield start, last


def _small(number: str) -> bool:
    digits = number.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for match in _IP.finditer(text):
        if all(map(_small, match.group().split("."))):
            yield match.span()


_DOUBLED = {str(d): 2 * d - 9 * (d > 4) for d in range(10)}


def passes_luhn(digits: str) -> bool:
    plain = sum(map(int, digits[-1::-2]))
    return (plain + sum(_DOUBLED[digit] for digit in digits[-2::-2])) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _CARD.finditer(text):
        digits = match.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and passes_luhn(digits):
            yield match.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for match in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", match.group())) <= 15:
            yield match.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of all seeds, sorted; kinds are numbered as listed."""
    found = []
    if "@" in text:
        found += [(start, 0, end) for start, end in _emails(text)]
    for kind, find in ((1, _ips), (2, _cards), (3, _phones)):
        found += [(start, kind, end) for start, end in find(text)]
    return sorted(found)


# ---- contexts -----------------------------------------------------------------------------


def _value(kind: int, written: str) -> str:
    """What makes two spellings one instance: the digits of a number, the letters of the rest."""
    if kind >= 2:
        plain = _NOT_DIGIT.sub("", written)
    else:
        plain = re.sub(r"[\s\[\](){}]", "", written).lower()
    return hashlib.md5(plain.encode()).hexdigest()


def sides(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a span: one and two words before it, one and two words after it.
    Digits are not told apart, so that a word with a number is one word."""
    before = text[max(0, start - CONTEXT) : start].lower().split()[-2:]
    after = text[end : end + CONTEXT].lower().split()[:2]
    before = [re.sub(r"[0-9]", "0", word) for word in before]
    after = [re.sub(r"[0-9]", "0", word) for word in after]
    found = []
    if before:
        found.append(f"{before[-1]} _")
    if len(before) == 2:
        found.append(f"{before[0]} {before[1]} _")
    if after:
        found.append(f"_ {after[0]}")
    if len(after) == 2:
        found.append(f"_ {after[0]} {after[1]}")
    return found


def _candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """``start, kind, end`` of identifier-like strings that touch no seed."""
    taken = sorted((start, end) for start, _, end in base)
    for number, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text and not _AT.search(text):
            continue
        at = 0
        for match in _SHAPES[kind].finditer(text):
            start, end = match.span()
            if kind == "ip" and not re.search(r"[0-9]", match.group()):
                continue
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if at == len(taken) or taken[at][0] >= end:
                yield start, number, end


def found_in(text: str) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """The seeds of a text, and seeds and candidates with their value and patterns."""
    base = base_spans(text)
    rows = [(start, kind, end, True) for start, kind, end in base]
    rows += [(start, kind, end, False) for start, kind, end in _candidates(text, base)]
    return base, [
        (KINDS[kind], start, end, seed, _value(kind, text[start:end]), sides(text, start, end))
        for start, kind, end, seed in rows
    ]


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _read(rows: DataFrame) -> DataFrame:
    """Per row: counts and spans of the seeds, and all that may be an instance."""
    key_type = rows.schema["id"].dataType.simpleString()
    names = ["kind", "start", "end", "base", "value", "sides"]
    fields = pa.struct(
        [
            ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
            ("base", pa.bool_()), ("value", pa.string()), ("sides", pa.list_(pa.string())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [[] for _ in KINDS]
            spans, found = [], []
            for text in batch.column(1).to_pylist():
                base, near = found_in(text or "")
                for kind, column in enumerate(counts):
                    column.append(sum(k == kind for _, k, _ in base))
                spans.append(_written(base))
                found.append([dict(zip(names, row)) for row in near])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(column, pa.int64()) for column in counts),
                    pa.array(spans, pa.string()),
                    pa.array(found, pa.list_(fields)),
                ],
                names=["id", *(f"n_{kind}" for kind in KINDS), "base", "found"],
            )

    counts = ", ".join(f"n_{kind} bigint" for kind in KINDS)
    return small_batches(rows).mapInArrow(
        run, f"id {key_type}, {counts}, base string, found array<{_CANDIDATE}>"
    )


# ---- the graph ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Bootstrap:
    """``instances``: value, kind and score of what the patterns found, seeds excluded.
    ``patterns``: pattern, kind, number of instances and score."""

    instances: DataFrame
    patterns: DataFrame


def _edges(found: DataFrame) -> DataFrame:
    """Each pattern with each instance in it, once: ``pattern, value, kind, seed``. Equal rows
    are merged before they are shuffled, so a value that many texts repeat weighs once."""
    return (
        found.select("value", "kind", "base", F.explode("sides").alias("pattern"))
        .groupBy("pattern", "value", "kind")
        .agg(F.max("base").alias("seed"))
    )


def _side(pattern: Column) -> Column:
    return F.when(F.startswith(pattern, F.lit("_ ")), F.lit("after")).otherwise(F.lit("before"))


def bootstrap(
    found: DataFrame,
    rounds: int = ROUNDS,
    least_instances: int = LEAST_INSTANCES,
    promoted: float = PROMOTED,
) -> Bootstrap:
    """Scores of the graph of ``found`` (``value, kind, base, sides`` of seeds and candidates).

    A round gives every pattern and kind the summed scores of its instances of that kind, divided by
    the number of all its instances and one; a pattern with a score below ``least_instances`` is
    no evidence. An instance that is no seed then takes the greatest score of the patterns before
    it and the greatest of those after it; both together are 1 less the product of what each lacks.
    A value has the kind with the highest score, and from ``promoted`` on it counts as an instance in
    the next round. A value that is a seed of any kind stays what it is.
    """
    edges = stage(_edges(found), "pii-edges")
    totals = edges.groupBy("pattern").agg(F.count_distinct("value").alias("total"))
    totals = stage(totals.where(F.col("total") >= least_instances), "pii-totals")
    known = edges.where("seed").select("value", "kind").distinct()
    seeds = known.withColumn("score", F.lit(UNIT).cast("bigint")).withColumn("seed", F.lit(True))
    seeds = stage(seeds, "pii-seeds")
    open_edges = stage(
        edges.where("NOT seed").join(seeds.select("value").distinct(), "value", "left_anti"),
        "pii-open",
    )
    instances = seeds
    for i in range(rounds):
        held = edges.select("pattern", "value", "kind").join(instances, ["value", "kind"])
        sums = held.groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
        strong = sums.where(F.col("mass") >= least_instances * UNIT).join(totals, "pattern")
        patterns = stage(
            strong.select(
                "pattern", "kind", "total",
                F.floor(F.col("mass") / (F.col("total") + 1)).cast("bigint").alias("score"),
            ),
            f"pii-patterns-{i}",
        )
        side = _side(F.col("pattern"))
        reached = (
            open_edges.join(patterns, ["pattern", "kind"])
            .groupBy("value", "kind")
            .agg(
                *(
                    F.coalesce(F.max(F.when(side == name, F.col("score"))), F.lit(0)).alias(name)
                    for name in ("before", "after")
                )
            )
        )
        lacks = (F.lit(UNIT) - F.col("before")) * (F.lit(UNIT) - F.col("after"))
        score = (F.lit(UNIT) - F.floor(lacks / UNIT)).cast("bigint").alias("score")
        scored = reached.select("value", "kind", score)
        # One kind for a value: that with the highest score.
        most = scored.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("most"))
        gained = stage(
            most.select("value", "most.kind", "most.score").where(
                F.col("score") >= int(promoted * UNIT)
            ),
            f"pii-gained-{i}",
        )
        instances = seeds.unionByName(gained.withColumn("seed", F.lit(False)))
    return Bootstrap(
        instances.where("NOT seed").select("value", "kind", "score"), patterns
    )


def _ordered(spans: Column) -> Column:
    order = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"),
            s["end"].alias("end"),
            s["kind"].alias("kind"),
        ),
    )
    named = F.transform(
        F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    )
    return F.array_join(named, ",")


def personal_data(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    rounds: int = ROUNDS,
    least_instances: int = LEAST_INSTANCES,
    promoted: float = PROMOTED,
) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row.

    The counts and the digest are those of the plain patterns; ``spans`` also has what the method
    found, each as ``kind:start:end`` in code points, by start. Found spans touch no seed.

    Texts are read once; what is written and shuffled are the strings that may be identifiers, with
    two words on either side. Patterns are built from all of them, without a bound on their number.
    Only rows that hold such a string beside their seeds are joined again, by the number of the row,
    so keys may be null or repeated and no value can fill a task: equal edges are merged
    before the shuffle, and joins run between written tables, which are split where a key is hot.

    Null and empty texts have no spans; rows that repeat a key or a text are documents of their
    own; a text of any length is read whole, each plain pattern in one pass. No rows give no rows.
    Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    # A row's number holds once it is written.
    read = stage(_read(rows).withColumn("row", F.monotonically_increasing_id()), "pii-read")
    found = read.where(F.size("found") > 0).select("row", F.inline("found"))
    graph = bootstrap(found, rounds, least_instances, promoted)
    gained = stage(graph.instances, "pii-instances")
    more = (
        found.where("NOT base")
        .select("row", "value", "kind", "start", "end")
        .join(gained.select("value", "kind"), ["value", "kind"])
        .groupBy("row")
        .agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    )
    candidates = F.exists("found", lambda s: ~s["base"])
    counts = [f"n_{kind}" for kind in KINDS]
    plain = read.where(~candidates).select("id", *counts, "base", F.col("base").alias("spans"))
    seeds = F.transform(
        F.filter("found", lambda s: s["base"]),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(
        _ordered(F.concat(seeds, "more"))
    )
    joined = (
        read.where(candidates)
        .select("row", "id", *counts, "base", "found")
        .join(more, "row", "left")
        .select("id", *counts, "base", every.alias("spans"))
    )
    return plain.unionByName(joined).select(
        F.col("id").alias("doc_id"), *counts, F.sha2("base", 256).alias("base_sha256"), "spans"
    )
