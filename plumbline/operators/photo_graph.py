"""Evidence graph: the photos of a session, in order of time, match objects that earlier photos founded, or found one.

What a photo says is read from its texts by column expressions. Placing photos depends on their order, since every founded
object changes what later photos may match; it is a fold per session. Sessions are dealt by hash and sorted inside
their partition, and a task walks over its rows batch by batch with the objects of one session at a time: a session of any number of
photos takes memory for its objects only. Objects and summaries are aggregates of the placed photos.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.answers import error_codes
from plumbline.operators.papers import let

# fixed values: how a brand, a model and a serial number are named in a text
NAMED = {
    "brand": r"(?i)\b(?:brand|marca)\s*[:#-]?\s*([A-Z0-9][A-Z0-9._ -]{1,24})",
    "model": r"(?i)\b(?:model|modelo|mod\.?)\s*[:#-]?\s*([A-Z0-9][A-Z0-9._/-]{2,30})",
    "serial": r"(?i)\b(?:serial|s\/n|sn|serie)\s*[:#-]?\s*([A-Z0-9][A-Z0-9._/-]{3,40})",
}
# fixed values: words of another object, words of the same one, and words that tell the kind of a view
ANOTHER = r"(?i)另一台|另外一台|另一个|不是这个|新的机器|different (?:device|machine)|otro equipo|otra maquina"
SAME = r"(?i)same|同一|这台|它的|这个设备|这机器|继续|背面|铭牌|这里|这个"
VIEWS = [
    ("nameplate", r"(?i)\b(model|modelo|serial|s\/n|voltage|voltaje|marca)\b"),
    ("display", r"(?i)\b(error|err|c[oó]digo|code)\b"),
    ("connection", r"(?i)接口|插头|线缆|connector|port|cable"),
    ("closeup", r"(?i)这里|局部|近照|close.?up"),
]
# fixed values: what agreement is worth, and from which score a photo shows a known object
BASE, SERIAL, MODEL, BRAND, OTHER_BRAND, LABEL, LABEL_SHARE, SAME_WORDS, CONFLICT = 0.18, 0.75, 0.48, 0.18, 0.2, 0.28, 0.25, 0.22, 0.05
SURE, MARGIN, LIKELY, UNLIKELY = 0.82, 0.15, 0.58, 0.22
LABELS, TEXT_CHARS, TEXTS = 6, 500, 6

_PLAIN = re.compile("[^a-z0-9]")


def named(text: Column, kind: str) -> Column:
    found = F.regexp_replace(F.trim(F.regexp_extract(text, NAMED[kind], 1)), r"\s{2,}", " ")
    return let(found, lambda x: F.nullif(x, F.lit("")))


def view_type(text: Column, user_text: Column, parts: Column) -> Column:
    said = F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(user_text, F.lit("")))
    view = F.when(said.rlike(VIEWS[0][1]), VIEWS[0][0])
    for kind, pattern in VIEWS[1:]:
        view = view.when(said.rlike(pattern), kind)
    return view.when(F.coalesce(F.size(parts), F.lit(0)) >= 3, "overview").otherwise("unknown_view")


def photo_evidence(photos: DataFrame) -> DataFrame:
    """Adds what a photo says to ``text, user_text, labels (array<struct<label,confidence>>), parts``: names, codes, view, and whether its words point to the same or another object."""
    text, words = F.trim(F.coalesce("text", F.lit(""))), F.coalesce("user_text", F.lit(""))
    order = lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0)
    labels = F.slice(F.array_sort(F.filter(F.coalesce("labels", F.array().cast("array<struct<label:string,confidence:double>>")), lambda x: x["label"] != ""), order), 1, LABELS)
    return photos.withColumns(
        {k: named(text, k) for k in NAMED}
        | {"error_codes": error_codes(text), "view": view_type(text, words, F.col("parts")), "labels": labels, "another": words.rlike(ANOTHER), "same": words.rlike(SAME), "ocr_text": F.left(text, F.lit(TEXT_CHARS))}
    )


def plain(text: str | None) -> str | None:
    return None if text is None else _PLAIN.sub("", text.lower())


class Session:
    """The objects of one session: their fields as numbers in growing arrays, and which of them have a label."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.names: dict[str, int] = {}
        self.fields = {k: np.full(16, -1) for k in NAMED}
        self.labelled: dict[str, list[int]] = {}

    def number(self, value: str | None) -> int:
        value = plain(value)
        return -1 if value is None else self.names.setdefault(value, len(self.names))

    def scores(self, own: dict[str, int], labels: list[dict], same: bool) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Score, hard conflict and reasons of every object."""
        n = len(self.ids)
        both = {k: (self.fields[k][:n] >= 0) & (own[k] >= 0) for k in NAMED}
        agree = {k: both[k] & (self.fields[k][:n] == own[k]) for k in NAMED}
        differ = {k: both[k] & ~agree[k] for k in NAMED}
        score = np.where(differ["serial"], 0.0, np.where(agree["serial"], BASE + SERIAL, BASE))
        score = np.where(differ["model"], np.minimum(score, CONFLICT), np.where(agree["model"], score + MODEL, score))
        score = np.where(agree["brand"], score + BRAND, np.where(differ["brand"], score - OTHER_BRAND, score))
        seen, gain = np.zeros(n, bool), np.zeros(n)
        for label in reversed(labels):  # the first label that an object has counts
            where = self.labelled.get(plain(label["label"]), [])
            seen[where], gain[where] = True, min(LABEL, (label["confidence"] or 0.0) * LABEL_SHARE)
        score = np.where(seen, score + gain, score)
        score = np.clip(score + SAME_WORDS if same else score, 0, 1)
        reasons = {f"{k}_{how}": on[k] for k in ("serial", "model", "brand") for how, on in (("match", agree), ("conflict", differ))} | {"visual_identity_match": seen}
        return score, differ["serial"] | differ["model"], reasons

    def place(self, photo: int, row: dict) -> tuple[int, str, float, str]:
        """The object of the next photo, found or founded: ``(entity, status, confidence, reasons)``."""
        own = {k: self.number(row[k]) for k in NAMED}
        labels = row["labels"] or []
        best, status, confidence, why = -1, "new_object", 0.9, ["no_existing_entity"]
        if self.ids and row["another"]:
            status, confidence, why = "likely_new_object", 0.98, ["user_explicit_new_object"]
        elif self.ids:
            score, conflict, reasons = self.scores(own, labels, row["same"])
            first = int(score.argmax())
            top, rival = float(score[first]), float(np.delete(score, first).max(initial=0.0))
            why = [name for name, on in reasons.items() if on[first]] + ["continuity_language"] * bool(row["same"])
            if conflict[first]:
                status, confidence = "likely_new_object", 0.95
            elif top >= SURE and (top - rival >= MARGIN or len(score) == 1):
                best, status, confidence = first, "same_object", top
            elif top >= LIKELY:
                best, status, confidence = first, "probably_same_object", top
            elif top <= UNLIKELY:
                status, confidence, why = "likely_new_object", 1 - top, why or ["insufficient_similarity"]
            else:
                status, confidence, why = "unresolved", 0.5, why or ["ambiguous_cross_photo_relationship"]
        if best < 0:
            best = len(self.ids)
            self.ids.append(photo)
            if best == len(self.fields["brand"]):
                self.fields = {k: np.r_[v, np.full(len(v), -1)] for k, v in self.fields.items()}
        for k, v in own.items():
            if self.fields[k][best] < 0:
                self.fields[k][best] = v
        for label in labels:
            where = self.labelled.setdefault(plain(label["label"]), [])
            if best not in where[-1:] and best not in where:
                where.append(best)
        return self.ids[best], status, confidence, ",".join(why)


def placed_photos(photos: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``(session, at, photo, entity, status, confidence, reasons)`` of :func:`photo_evidence` rows ``session, at, photo``; an object has the id of the photo that founded it. Columns to carry come along unread."""
    carry = carry or []
    cols = ["session", "at", "photo", *NAMED, "labels", "another", "same"]
    sorted_rows = photos.select(*cols, *carry).repartition("session").sortWithinPartitions("session", "at", "photo")
    kinds = dict(photos.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, session = None, Session()
        for batch in batches:
            found = []
            for row in batch.select(cols).to_pylist():
                if row["session"] != current or not session.ids:
                    current, session = row["session"], Session()
                found.append(session.place(row["photo"], row))
            entity, status, confidence, reasons = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(entity, pa.int64()), pa.array(status, pa.string()), pa.array(confidence, pa.float64()), pa.array(reasons, pa.string()), *(batch.column(c) for c in carry)],
                ["session", "at", "photo", "entity", "status", "confidence", "reasons", *carry],
            )

    return sorted_rows.mapInArrow(run, f"session {kinds['session']}, at {kinds['at']}, photo bigint, entity bigint, status string, confidence double, reasons string" + "".join(f", {c} {kinds[c]}" for c in carry))


LISTS = ["views", "error_codes", "states", "parts"]


def said(texts: bool = True) -> Column:
    """What a photo of :func:`photo_evidence` says, as an array of ``(kind, value, place)``; texts only if they are wanted."""
    lists = {"views": F.array("view"), "error_codes": F.col("error_codes"), "states": F.col("states"), "parts": F.col("parts")}
    lists |= {"texts": F.array(F.when(F.col("ocr_text") != "", F.col("ocr_text")))} if texts else {}
    kinds = {"photo": F.array(F.lit("*"))} | {k: F.array(k) for k in NAMED} | lists  # every photo has one row of the first kind
    row = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), x.alias("value"), i.alias("place"))
    as_rows = [F.transform(F.coalesce(v, F.array().cast("array<string>")), row(k)) for k, v in kinds.items()]
    names = list(NAMED)
    return F.filter(F.concat(*as_rows), lambda x: x["value"].isNotNull() & (x["kind"].isin(names) | (x["value"] != "")))


def entity_summary(evidence: DataFrame, placed: DataFrame) -> DataFrame:
    """One row an object: its names, the photos and views of it, and its codes, states, parts and last texts, each once in order of appearance."""
    return summarised(evidence.select("photo", said().alias("said")).join(placed.select("at", "photo", "entity"), "photo"), True)


def summarised(photos: DataFrame, texts: bool) -> DataFrame:
    """Rows ``at, photo, entity, said`` to one an object: each value is kept once, by its first turn, and the values of an object are put together at the end."""
    lists = [*LISTS, "texts"] if texts else LISTS
    rows = photos.select("entity", "at", "photo", F.inline("said"))
    once = rows.groupBy("entity", "kind", "value").agg(F.count("*").alias("n"), F.min(F.struct(F.struct("at", "photo").alias("turn"), "place")).alias("first"))
    if texts:
        late = F.row_number().over(Window.partitionBy("entity", "kind").orderBy(F.desc("first")))
        last = once.filter("kind = 'texts'").withColumn("late", late).filter(F.col("late") <= TEXTS).drop("late")
        once = once.filter("kind <> 'texts'").unionByName(last)
    named = lambda k: F.min_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.col("first"))).alias(k)
    listed = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("first", "value"))))["value"]
    found = once.groupBy("entity").agg(F.sum(F.when(F.col("kind") == "photo", F.col("n"))).alias("photos"), *(named(k) for k in NAMED), *(listed(k).alias(k) for k in lists))
    return found.withColumns({k: F.when(F.size(k) > 0, F.col(k)) for k in lists})
