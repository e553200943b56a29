"""License scans with ordered signature rules, DataFrame functions only.

Rules are the hand-written signatures of ``_signatures``: regular expressions over
the words of a text (A-Z lower-cased, words joined by single spaces).  The rules of
one family and priority are one pattern of ordered alternatives, tried only where
the text holds a keyword of the family.  Detections are word intervals; one that
lies inside another detection is suppressed if the other's rule has the higher
priority, or the same with a longer interval, or an equal interval and an earlier
rule: detections are put in order of their starts and gone through once.

Texts without any stem of ``GATE`` are settled by tests of the whole text.
Everything is done inside a row: nothing is shuffled.

Defined cases: null texts are empty; a text without words has no places, null
positions, no labels and score 0; overlapping phrases all count as places;
repeated rows get equal results; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm._signatures import SIGNATURES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of texts as they are.
NOT_WORD_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: A text without any of these holds no detection: each is in every match of some rules, and every rule has one.
GATE = (
    "licen", "permission", "redistribut", "provided", "neither the name", "terms of the gnu", "apache", "asl ", "asf ", "expat", "gpl", "bsd", " mpl", " epl", "no attribution", "cddl", "cc0", "cc by", "creative commons", "waived all",
    "bsl 1", "artistic 2", "terms as perl", "unencumbered", "do what the fuck", "wtfpl", "psf 2", "ofl 1", "eupl", "odbl", "w3c software", "cecill", "mulan", "nasa open", "busl", "reserved",
    "unauthorized copying", "confidential", "public domain", "under the mit", "under the terms of the mit",
)
#: A word never holds these: they stand around a match.
OPEN, CLOSE = "\x01", "\x02"
#: Items of an array that grows one by one are kept in blocks of this size.
BLOCK = 256
SPAN = "struct<start:int,low:int,rank:int,rule:int,label:string>"


@dataclass(frozen=True)
class Rule:
    """One signature: a pattern of whole words, its family and the family's keywords, label and priority."""

    family: str
    keywords: tuple[str, ...]
    pattern: str
    label: str
    priority: int


def rules(text: str = SIGNATURES) -> list[Rule]:
    """The rules of a text of signatures, in order."""
    out, family, keywords = [], "", ()
    for line in filter(None, map(str.strip, text.splitlines())):
        if line.startswith("["):
            family, _, words = line[1:-1].partition(": ")
            keywords = tuple(words.split(", "))
        else:
            priority, label, pattern = line.split(" ", 2)
            out.append(Rule(family, keywords, pattern, label, int(priority)))
    return out


def _spaces(x: Column) -> Column:
    return (F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))).cast("int")


def _grow(start: dict[str, Column], kind: str) -> Column:
    """An accumulator with fields of its own and a growing array, which is copied block by block only."""
    return F.struct(*[v.alias(k) for k, v in start.items()], F.array().cast(f"array<array<{kind}>>").alias("done"), F.array().cast(f"array<{kind}>").alias("last"))


def _push(acc: Column, item: Column, keep: Column | None = None) -> list[Column]:
    """The array's fields with one item more, if ``keep``."""
    full = F.size(acc["last"]) >= BLOCK
    done = F.when(full, F.concat(acc["done"], F.array(acc["last"]))).otherwise(acc["done"])
    last = F.when(full, F.array(item)).otherwise(F.concat(acc["last"], F.array(item)))
    if keep is None:
        return [done.alias("done"), last.alias("last")]
    return [F.when(keep, done).otherwise(acc["done"]).alias("done"), F.when(keep, last).otherwise(acc["last"]).alias("last")]


def _grown(acc: Column) -> Column:
    return F.concat(F.flatten(acc["done"]), acc["last"])


def _bound(x: Column, f) -> Column:
    """``f(x)`` with ``x`` made once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _marked(text: Column, pattern: str) -> Column:
    """The text with every match of a pattern of whole words marked."""
    return F.regexp_replace(text, f"(?<= )(?:{pattern})(?= )", f"{OPEN}$0{CLOSE}")


def _found(marked: Column, made, kind: str) -> Column:
    """``made(start, end, hit)`` for every marked match; words are numbered from 0."""

    def step(acc: Column, piece: Column) -> Column:
        hit, rest = F.substring_index(piece, CLOSE, 1), F.substring_index(piece, CLOSE, -1)
        last = acc["at"] - 1 + _spaces(hit)
        return F.struct((last + 1 + _spaces(rest)).alias("at"), *_push(acc, made(acc["at"] - 1, last, hit)))

    def found(pieces: Column) -> Column:
        return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), _grow({"at": _spaces(F.element_at(pieces, 1))}, kind), step, _grown)

    return _bound(F.split(marked, OPEN, -1), found)


def _detected(text: Column, items: list[Rule]) -> Column:
    """All detections, in order of start, longer ones first, then by priority and rule."""
    passes = [list(run) for _, run in groupby(sorted(enumerate(items), key=lambda ir: (ir[1].family, -ir[1].priority)), key=lambda ir: (ir[1].family, ir[1].priority))]
    has = {r.keywords: reduce(or_, (F.contains(text, F.lit(k)) for k in r.keywords)) for r in items}
    marked = F.array(*[F.when(has[run[0][1].keywords], _marked(text, "|".join(r.pattern for _, r in run))) for run in passes])
    rows = [[{"pattern": f"^(?:{r.pattern})$", "rule": i, "rank": -r.priority, "label": r.label} for i, r in run] for run in passes]
    table = F.from_json(F.lit(json.dumps(rows)), "array<array<struct<pattern:string,rule:int,rank:int,label:string>>>")

    def one(m: Column, rank: Column) -> Column:
        def made(first: Column, last: Column, hit: Column) -> Column:
            # a match is that of the first rule that fits it whole
            fit = F.element_at(F.filter(F.element_at(table, rank + 1), lambda r: F.rlike(hit, r["pattern"])), 1)
            return _bound(fit, lambda r: F.struct(first.alias("start"), (-last).alias("low"), r["rank"].alias("rank"), r["rule"].alias("rule"), r["label"].alias("label")))

        return F.when(F.contains(m, F.lit(OPEN)), _found(m, made, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.array_sort(F.flatten(F.transform(marked, one)))


def _standing(spans: Column, levels: tuple[int, ...]) -> Column:
    """Of detections in order, those that no other suppresses.

    One that suppresses another comes before it, so the largest end so far of each
    priority tells: a detection falls if one of its priority or above reaches its end.
    """
    start = _grow({f"p{n}": F.lit(-1) for n in levels}, SPAN)

    def step(acc: Column, d: Column) -> Column:
        end = -d["low"]
        stands = ~reduce(or_, ((F.lit(n) >= -d["rank"]) & (acc[f"p{n}"] >= end) for n in levels))
        ends = [F.when((-d["rank"] == n) & (end > acc[f"p{n}"]), end).otherwise(acc[f"p{n}"]).alias(f"p{n}") for n in levels]
        return F.struct(*ends, *_push(acc, d, stands))

    return F.aggregate(spans, start, step, _grown)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", signatures: list[Rule] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    ``detections`` has start and end (words from 0), priority, rule and label.
    ``score`` is the share of the text's words that standing detections cover
    (at most 1), to the power 1/4.
    """
    items = rules() if signatures is None else signatures
    bare = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), NOT_WORD_RAW, " "))
    held = docs.select(F.col(id_col).alias("doc_id"), bare.alias("bare"))
    count = F.when(F.col("bare") == "", 0).otherwise(_spaces(F.col("bare")) + 1).cast("long")
    gate = reduce(or_, (F.contains(F.col("low"), F.lit(g)) for g in GATE)) if signatures is None else F.lit(True)
    held = held.select("doc_id", "bare", count.alias("n_words"), F.concat(F.lit(" "), F.lower("bare"), F.lit(" ")).alias("low"))
    held = held.select("doc_id", "n_words", F.when((F.col("n_words") > 0) & gate, F.concat(F.lit(" "), F.translate("bare", UPPER, LOWER), F.lit(" "))).alias("normal"))
    normal, none = F.col("normal"), F.array().cast("array<int>")
    places = [F.when(F.contains(normal, F.lit(phrase)), _found(_marked(normal, phrase), lambda first, last, hit: first, "int")).otherwise(none).alias(f"_{k}") for phrase, k in BASE.items()]
    spans = F.when(normal.isNotNull(), _detected(normal, items)).otherwise(F.array().cast(f"array<{SPAN}>"))
    held = held.select("doc_id", "n_words", *places, spans.alias("spans"))
    held = held.select("*", _standing(F.col("spans"), tuple(sorted({r.priority for r in items}))).alias("stand"))
    shown = F.transform("stand", lambda d: F.struct(d["start"].alias("start"), (-d["low"]).alias("end"), (-d["rank"]).alias("priority"), d["rule"].alias("rule"), d["label"].alias("label")))
    held = held.select("*", shown.alias("detections"))
    every = F.concat(*[F.col(f"_{k}") for k in BASE.values()])
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"_{k}") > 0, F.lit(k)) for k in BASE.values()])))
    labels = F.array_sort(F.array_distinct(F.concat(base, F.col("detections.label"))))
    covered = F.aggregate("detections", F.lit(0), lambda a, d: a + d["end"] - d["start"] + 1)
    return held.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_words") > 0, F.pow(F.least(F.lit(1.0), covered / F.col("n_words")), F.lit(0.25))).otherwise(F.lit(0.0)).alias("score"), "detections",
    )
