"""SentencePiece encoding and decoding with a relational lattice.

Texts are cut into words, at spaces, and words into units, at places that no piece can span (between two
characters that are neighbours in no piece), so each distinct unit is encoded once. The lattice of the
units is a table: their substrings up to the longest piece are exploded and equi-joined to the piece table,
edges are grouped by unit, and Viterbi is a Spark ``aggregate`` over a unit's edges, with a back-trace.

For unigram models an edge may follow any edge and the best sum of scores wins. For BPE models the best sum
of scores is not what merging yields, but a segmentation is the merge result if and only if merging each two
neighbours' joined text leaves exactly those two. So every edge carries the set of edges that it may follow, and
the fold takes the best path among those; it gives the library's ids.

Units of the words that are frequent in a bounded random sample (``SAMPLE`` texts, ``FREQUENT`` words) are encoded first and
sent to every task; the sample decides only where a unit is looked up, never its ids. Texts then become
sequences of ids with gaps; the units of the gaps are shuffled once, encoded where they meet, and their ids go back
to the texts. Characters that no piece holds become byte pieces; runs of spaces become the longest run pieces.

Edge cases: null and empty texts have no pieces; a literal space mark (U+2581) decodes as a space, as in the library;
equal texts share their units; repeated rows and null ids do no harm; other columns are kept. A unit may be as long as
its text. No piece of a BPE model may have over 63 characters.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import written

SPACE = "▁"
SAMPLE, FREQUENT = 50_000, 300_000
MEMORY, PAIRS = 2_000_000, 500_000
SLICE = 1_500
SPREAD = 3


@dataclass
class Pieces:
    """A piece table: ids and scores of ordinary pieces, ids of byte pieces, and what follows from them."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    merges: bool
    longest: int = 0
    runs: list[int] = field(default_factory=list)
    halves: dict[str, tuple[str, str]] = field(default_factory=dict)
    odd: set[str] = field(default_factory=set)
    width: np.dtype = np.dtype(np.uint32)
    kind: np.ndarray | None = None
    near: np.ndarray | None = None

    def __post_init__(self) -> None:
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        letters = {c: k for k, c in enumerate(sorted({c for pair in pairs for c in pair}), 1)}
        self.kind = np.zeros(0x110000, np.int32)
        self.near = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for c, k in letters.items():
            self.kind[ord(c)] = k
        for a, b in pairs:
            self.near[letters[a], letters[b]] = True
        self.longest = max(map(len, self.ids))
        # the type of packed ids; its largest value marks a gap
        self.width = np.dtype(np.uint16 if max(*self.ids.values(), *self.byte_ids) < 65_535 else np.uint32)
        self.runs = sorted((len(p) for p in self.ids if set(p) == {SPACE}), reverse=True)
        if self.merges:
            for piece in self.ids:
                self.merged(piece, self.halves)
            for piece in sorted(self.halves, key=len):  # pieces formed no later than one of their parts
                if any(half in self.odd or len(half) > 1 and self.scores[half] <= self.scores[piece] for half in self.halves[piece]):
                    self.odd.add(piece)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Reads the pieces from a SentencePiece model file."""
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto()).trainer_spec
        every = range(model.get_piece_size())
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        by_byte = {model.id_to_piece(i): i for i in every if model.is_byte(i)}
        return cls(
            {model.id_to_piece(i): i for i in plain},
            {model.id_to_piece(i): model.get_score(i) for i in plain},
            [by_byte.get(f"<0x{b:02X}>", model.unk_id()) for b in range(256)],
            merges=spec.model_type == spec.BPE,
        )

    def pack(self, ids: list[int] | np.ndarray) -> bytes:
        return np.asarray(ids, self.width).tobytes()

    def cut(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The units of words with their marks, in order, and how many each word has: cut between characters that are neighbours in no piece."""
        if not words:
            return [], np.zeros(0, np.int64)
        text = SPACE + SPACE.join(words)
        kinds = self.kind[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        apart = np.r_[True, ~self.near[kinds[:-1], kinds[1:]], True]
        apart[starts] = True
        cuts = np.flatnonzero(apart)
        places = cuts.tolist()
        return [text[i:j] for i, j in zip(places, places[1:], strict=False)], np.diff(np.searchsorted(cuts, starts))

    def merged(self, text: str, halves: dict | None = None) -> list[str]:
        """The pieces left when the best-scored neighbours of a short text are merged until none can be."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            if halves is not None and len(parts) == 2:
                halves[text] = (parts[0], parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether merging leaves the two pieces as neighbours.

        Walks back in time: the later formed of the two is split, and no piece across the border
        may have been better than what was formed next.
        """
        if a in self.odd or b in self.odd:
            return self.merged(a + b) == [a, b]
        scores, halves, last, left_first = self.scores, self.halves, -np.inf, False
        while True:
            across = scores.get(a + b)
            if across is not None and (across > last or across == last and not left_first):
                return False
            score_a, score_b = scores[a] if len(a) > 1 else np.inf, scores[b] if len(b) > 1 else np.inf
            if score_a == score_b == np.inf:
                return True
            if score_a < score_b:
                last, left_first, a = score_a, True, halves[a][1]
            else:
                last, left_first, b = score_b, False, halves[b][0]

    def space_run(self, n: int) -> list[int]:
        out = []
        for size in self.runs:
            out += [self.ids[SPACE * size]] * (n // size)
            n %= size
        return out

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]

    def is_unit(self, unit: str) -> bool:
        """Whether the lattice encodes it; a single character without a piece becomes bytes."""
        return len(unit) > 1 or unit in self.ids


def parts_of(text: str | None) -> list[str]:
    """What stands between the spaces of a text, without marks; empty parts are further spaces."""
    return text.replace(SPACE, " ").split(" ") if text else []


def words_of(texts: pa.Array) -> pa.ListArray:
    """The parts of each text, as :func:`parts_of` gives them; a text without any has one that is empty."""
    return pc.split_pattern(pc.replace_substring(texts.fill_null(""), SPACE, " "), " ")


def frequent_words(docs: DataFrame, limit: int = FREQUENT, sample: int = SAMPLE) -> DataFrame:
    """``(word)``: the most frequent words of about ``sample`` texts, at most ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for k in range(0, len(texts), SLICE):
                counted = pc.value_counts(words_of(texts.slice(k, SLICE)).flatten())
                counted = counted.filter(pc.not_equal(counted.field(0), ""))
                yield pa.RecordBatch.from_arrays([counted.field(0), counted.field(1)], ["word", "n"])

    share = min(1.0, sample / max(1, docs.count()))
    found = docs.select("text").sample(share, seed=1).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(limit).select("word")


def units_of(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``(unit, n)``: the distinct units of the words and their lengths."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            units = set(filter(own.is_unit, own.cut(batch.column(0).to_pylist())[0]))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(units), pa.string())], ["unit"])

    return words.mapInArrow(run, "unit string").groupBy("unit").agg(F.max(F.length("unit")).alias("n"))


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """``(unit, n, edges)`` of units ``(unit, n)``: a unit's edges ``(end, start, id, score)`` in that order.

    Grouping needs no shuffle of its own where the units come from a grouping or partitioning by unit.
    """
    spark = units.sparkSession
    good = [p for p in pieces.ids if not pieces.merges or pieces.merged(p) == [p]]
    table = spark.createDataFrame(pd.DataFrame({"piece": good, "id": [pieces.ids[p] for p in good], "score": [pieces.scores[p] for p in good]}))
    table = table.select("piece", F.col("id").cast("int"), "score")
    starts = units.select("unit", "n", F.xxhash64("unit").alias("u"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    ends = starts.select("unit", "n", "u", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("n"), F.col("start") + pieces.longest))).alias("end"))
    parts = ends.withColumn("piece", F.substring(F.col("unit"), F.col("start") + 1, F.col("end") - F.col("start")))
    edges = parts.join(F.broadcast(table), "piece")  # the piece table is one model's vocabulary
    # the hash comes first so that grouping sorts by a number
    return edges.groupBy("u", "unit", "n").agg(F.sort_array(F.collect_list(F.struct("end", "start", "id", "score"))).alias("edges"))


class Fits:
    """Which edges may follow which: one bit for each length of the edge before. What is known of two pieces is kept in sorted arrays."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.name = dict(zip(pieces.ids.values(), pieces.ids, strict=True))
        self.keys, self.values = np.zeros(0, np.int64), np.zeros(0, bool)

    def known(self, keys: np.ndarray) -> np.ndarray:
        """For keys ``left id << 32 | right id``, whether merging leaves the two as neighbours."""
        found, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.keys, found)
        new = found[np.r_[self.keys, -1][at] != found]
        if len(new):
            if len(self.keys) > MEMORY:
                self.keys, self.values = np.zeros(0, np.int64), np.zeros(0, bool)
                new = found
            fits, name = self.pieces.fits, self.name
            made = [fits(name[x >> 32], name[x & 0xFFFFFFFF]) for x in new.tolist()]
            self.keys, self.values = np.r_[self.keys, new], np.r_[self.values, made].astype(bool)
            order = np.argsort(self.keys, kind="stable")
            self.keys, self.values = self.keys[order], self.values[order]
        return self.values[np.searchsorted(self.keys, found)][back]

    def bits(self, starts: np.ndarray, ids: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For edges whose ``counts`` edges before them stand from ``firsts`` on: bit ``n - 1`` if one of ``n`` characters may be there."""
        out = np.zeros(len(starts), np.int64)
        at = 0
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(np.cumsum(counts[at:]), PAIRS)) + at)
            n = counts[at:stop]
            right = np.repeat(np.arange(at, stop), n)
            left = np.repeat(firsts[at:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())
            may = self.known((ids[left] << 32) | ids[right])
            np.bitwise_or.at(out, right[may], np.int64(1) << (starts[right] - starts[left] - 1)[may])
            at = stop
        return out


def edges_by_end(edges: DataFrame, pieces: Pieces) -> DataFrame:
    """``(unit, by_end)``: for every end in a unit its edges ``(start, id, score, fits)``.

    ``fits`` says by bits which edges one may follow, by their length; for unigram models all bits are set. Edges that may follow none are left out.
    """
    if pieces.merges and pieces.longest > 63:
        raise ValueError("a piece has over 63 characters")
    shared = edges.sparkSession.sparkContext.broadcast(pieces)
    memory: list[Fits] = []

    @F.arrow_udf("array<array<struct<start:int,id:int,score:double,fits:bigint>>>")
    def run(lengths: pa.Array, starts: pa.Array, ends: pa.Array, ids: pa.Array, scores: pa.Array) -> pa.Array:
        if not memory:
            memory.append(Fits(shared.value))
        length, per_unit = lengths.to_numpy().astype(np.int64), starts.value_lengths().to_numpy()
        start, end, piece = (a.flatten().to_numpy().astype(np.int64) for a in (starts, ends, ids))
        outer = np.r_[0, np.cumsum(length)]
        place_of = np.repeat(outer[:-1], per_unit) + end - 1
        by_place = lambda places: np.r_[0, np.cumsum(np.bincount(places, minlength=int(outer[-1])))]
        inner = by_place(place_of)
        bits = np.full(len(start), -1, np.int64)
        flat = [starts.flatten(), ids.flatten(), scores.flatten()]
        if memory[0].pieces.merges:
            later = np.flatnonzero(start > 0)
            place = place_of[later] - end[later] + start[later]  # edges are in order of unit and end, so those before one stand together
            counts, firsts = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
            counts[later], firsts[later] = inner[place + 1] - inner[place], inner[place]
            bits = memory[0].bits(start, piece, firsts, counts)
            kept = np.flatnonzero((start == 0) | (bits != 0))  # an edge that may follow none is on no path
            flat, bits, inner = [a.take(pa.array(kept)) for a in flat], bits[kept], by_place(place_of[kept])
        edges = pa.StructArray.from_arrays([*flat, pa.array(bits)], ["start", "id", "score", "fits"])
        return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), edges))

    return edges.select("unit", run(F.length("unit"), "edges.start", "edges.end", "edges.id", "edges.score").alias("by_end"))


def best_paths(edges: DataFrame) -> DataFrame:
    """``(unit, ids)``: Viterbi over the edges ``by_end`` of each unit; no row for a unit of which no path reaches the end.

    The fold's state holds for every position the last piece of the best path to it.
    """
    cell = "struct<id:int,score:double,src:int>"
    trace = "struct<at:int,ids:array<int>>"
    size = F.length("unit")
    origin = F.struct(F.lit(-1).alias("id"), F.lit(0.0).alias("score"), F.lit(-1).alias("src")).cast(cell)
    unreached = F.struct(F.lit(-2).alias("id"), F.lit(0.0).alias("score"), F.lit(-1).alias("src")).cast(cell)

    def take(cells, here):
        def usable(e):
            before = F.get(cells, e["start"])
            may = F.call_function("shiftright", e["fits"], e["start"] - before["src"] - 1).bitwiseAND(F.lit(1).cast("bigint")) == 1
            return (before["id"] > -2) & ((e["start"] == 0) | may)

        def reached(e):
            score = F.get(cells, e["start"])["score"] + e["score"]
            return F.struct(score.alias("score"), (-e["start"]).alias("longer"), e["id"].alias("id"), e["start"].alias("src"))

        best = F.array_max(F.transform(F.filter(here, usable), reached))
        fresh = F.transform(F.array(best), lambda b: F.when(b.isNull(), unreached).otherwise(F.struct(b["id"], b["score"], b["src"]).cast(cell)))
        return F.concat(cells, fresh).cast(f"array<{cell}>")

    def back(cells):
        def step(state, _):
            now = F.get(cells, state["at"])
            more = F.struct(now["src"].alias("at"), F.concat(F.array(now["id"]), state["ids"]).alias("ids")).cast(trace)
            return F.when((state["at"] > 0) & (now["id"] > -2), more).otherwise(state)

        end = F.struct(size.alias("at"), F.array().cast("array<int>").alias("ids")).cast(trace)
        return F.aggregate(F.sequence(F.lit(1), size), end, step)

    # explode evaluates the edges and the fold once a unit
    folded = edges.select("unit", F.explode(F.transform(F.array("by_end"), lambda x: F.aggregate(x, F.array(origin).cast(f"array<{cell}>"), take, back))).alias("path"))
    return folded.filter(F.col("path.at") == 0).select("unit", F.col("path.ids").alias("ids"))


def encoded_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """``(unit, ids)`` of every distinct unit; a unit of which no path reaches the end has no row."""
    return best_paths(edges_by_end(lattice(units, pieces), pieces))


def frequent_ids(docs: DataFrame, pieces: Pieces, limit: int = FREQUENT) -> tuple[dict[str, bytes], dict[str, bytes]]:
    """Packed ids of at most ``limit`` frequent words and of their units."""
    if not limit:
        return {}, {}
    words = written(frequent_words(docs, limit), "frequent-words")
    got = written(encoded_units(units_of(words, pieces), pieces), "frequent-units").toArrow()
    lists = got["ids"].combine_chunks()
    flat, at = pieces.pack(lists.flatten().to_numpy()), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())] * pieces.width.itemsize
    units = {u: flat[at[k] : at[k + 1]] for k, u in enumerate(got["unit"].to_pylist())}
    whole = Encoder(pieces, units, {}).resolved(words.toArrow()["word"].to_pylist())
    return units, {word: ids for word, (ids, gaps) in whole.items() if not gaps}


class Encoder:
    """Turns texts into packed ids with gaps for unknown units, and fills the gaps."""

    def __init__(self, pieces: Pieces, units: dict[str, bytes], words: dict[str, bytes]):
        self.pieces, self.units, self.words = pieces, units, words | {"": b""}
        self.step = pieces.width.itemsize
        self.mark = pieces.pack([pieces.ids[SPACE]])
        self.gap = pieces.pack([np.iinfo(pieces.width).max])
        self.listed, self.lists = pa.array(self.words, pa.string()), self.id_lists(list(self.words.values()))

    def id_lists(self, packed: list[bytes]) -> pa.ListArray:
        """Packed ids as lists."""
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.step
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.frombuffer(b"".join(packed), self.pieces.width)))

    def resolved(self, words: list[str]) -> dict[str, tuple[bytes, list[str]]]:
        """For each word its packed ids, with gaps, and the units of the gaps."""
        flat, counts = self.pieces.cut(words)
        found = list(map(self.units.get, flat))
        out, at = {}, 0
        for word, n in zip(words, counts.tolist(), strict=True):
            ids, gaps = found[at : at + n], []
            if None in ids:
                for k, own in enumerate(ids):
                    if own is None:
                        unit = flat[at + k]
                        if self.pieces.is_unit(unit):
                            ids[k] = self.gap
                            gaps.append(unit)
                        else:
                            ids[k] = self.units[unit] = self.pieces.pack(self.pieces.bytes_of(unit))
            out[word] = b"".join(ids), gaps
            at += n
        return out

    def after_run(self, ids: bytes, run: int) -> bytes:
        """The ids of ``run`` spaces and of the word after them."""
        if ids.startswith(self.mark):
            ids, run = ids[self.step :], run + 1
        return self.pieces.pack(self.pieces.space_run(run)) + ids

    def gaps(self, texts: pa.Array) -> tuple[list[np.ndarray], list[str]]:
        """For each text the numbers of the units of its gaps, as :meth:`encode` gives them, without its ids; the units."""
        lists = words_of(texts)
        coded = lists.flatten().dictionary_encode()
        rare = np.flatnonzero(~pc.is_in(coded.dictionary, value_set=self.listed).to_numpy(zero_copy_only=False))
        flat, counts = self.pieces.cut(coded.dictionary.take(pa.array(rare)).to_pylist())
        new = [k for k, unit in enumerate(flat) if unit not in self.units and self.pieces.is_unit(unit)]
        units = sorted({flat[k] for k in new})
        number = {unit: k for k, unit in enumerate(units)}
        owned = np.zeros(len(coded.dictionary), np.int64)
        owned[rare] = np.bincount(np.repeat(np.arange(len(rare)), counts)[new], minlength=len(rare)) if new else 0
        found, ends = self.taken(self.listed_by(pa.array([number[flat[k]] for k in new], pa.int32()), owned), coded.indices, lists)
        return [found[i:j] for i, j in zip(ends, ends[1:], strict=False)], units

    def encode(self, texts: pa.Array) -> tuple[list[bytes], list[np.ndarray], list[list[int]], list[str]]:
        """For each text its packed ids with gaps, for every gap the number of its unit and (or nothing) how many spaces stand before it; the units.

        Words are looked up once a batch; what follows from a word is then taken for each place it has.
        """
        lists = words_of(texts)
        coded = lists.flatten().dictionary_encode()
        where = pc.index_in(coded.dictionary, value_set=self.listed)
        rare = np.flatnonzero(where.is_null().to_numpy(zero_copy_only=False))
        words = coded.dictionary.take(pa.array(rare)).to_pylist()
        known = self.resolved(words)
        units = sorted({unit for _, own in known.values() for unit in own})
        number = {unit: k for k, unit in enumerate(units)}
        owned = np.zeros(len(coded.dictionary), np.int64)
        owned[rare] = [len(known[word][1]) for word in words]
        own = pa.array([number[unit] for word in words for unit in known[word][1]], pa.int32())
        gaps, gap_ends = self.taken(self.listed_by(own, owned), coded.indices, lists)
        place = where.fill_null(0).to_numpy().astype(np.int64)
        place[rare] = len(self.lists) + np.arange(len(rare))
        every = pa.concat_arrays([self.lists, self.id_lists([known[word][0] for word in words])])
        ids, ends = self.taken(every, pa.array(place).take(coded.indices), lists)
        packed = [ids[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)]
        numbers = [gaps[i:j] for i, j in zip(gap_ends, gap_ends[1:], strict=False)]
        runs: list[list[int]] = [[]] * len(packed)
        at_empty = pc.index(coded.dictionary, "").as_py()
        if at_empty >= 0:
            places = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            for k in np.unique(np.searchsorted(places, np.flatnonzero(coded.indices.to_numpy() == at_empty), "right") - 1).tolist():
                parts = parts_of(texts[k].as_py())
                packed[k], found, runs[k] = self.with_runs(parts, {part: known.get(part) or (self.words[part], []) for part in parts})
                numbers[k] = np.array([number[u] for u in found], np.int32)
        return packed, numbers, runs, units

    @staticmethod
    def listed_by(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), values)

    @staticmethod
    def taken(values: pa.ListArray, indices: pa.Array, texts: pa.ListArray) -> tuple[np.ndarray, list[int]]:
        """What the words of the texts have in ``values``, one after the other, and where that of each text begins and ends."""
        out = values.take(indices)
        ends = np.r_[0, np.cumsum(out.value_lengths().to_numpy())]
        return out.flatten().to_numpy(), ends[np.r_[0, np.cumsum(texts.value_lengths().to_numpy())]].tolist()

    def with_runs(self, parts: list[str], known: dict[str, tuple[bytes, list[str]]]) -> tuple[bytes, list[str], list[int]]:
        """The same for one text with more than single spaces between its words."""
        out: list[bytes] = []
        gaps: list[str] = []
        runs: list[int] = []
        run = 0
        for part in parts:
            if not part:
                run += 1
                continue
            ids, own = known[part]
            gaps += own
            runs += [0] * len(own)
            if run and ids.startswith(self.gap):
                runs[-len(own)], run = run, 0
            elif run:
                ids, run = self.after_run(ids, run), 0
            out.append(ids)
        if run:
            out.append(self.pieces.pack(self.pieces.space_run(run)))
        return b"".join(out), gaps, runs

    def packed(self, answers: pa.ListArray) -> Iterator[list[bytes]]:
        """The lists of ids of each row, packed."""
        lists = answers.flatten()
        flat, ends = self.pieces.pack(lists.flatten().to_numpy()), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())] * self.step
        cut = [flat[i:j] for i, j in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
        places = np.r_[0, np.cumsum(answers.value_lengths().fill_null(0).to_numpy())].tolist()
        return (cut[i:j] for i, j in zip(places, places[1:], strict=False))

    def fill(self, packed: bytes, numbers: list[int], runs: list[int], answers: list[bytes]) -> np.ndarray:
        """The ids with every gap filled from the answers."""
        if numbers:
            out, last, step = [], 0, self.step
            gaps = np.flatnonzero(np.frombuffer(packed, self.pieces.width) == np.iinfo(self.pieces.width).max).tolist()
            for gap, number, run in zip(gaps, numbers, runs or [0] * len(gaps), strict=True):
                out += [packed[last : gap * step], self.after_run(answers[number], run) if run else answers[number]]
                last = (gap + 1) * step
            packed = b"".join([*out, packed[last:]])
        return np.frombuffer(packed, self.pieces.width)


def ranked(numbers: list[np.ndarray], units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For gaps with the numbers of their units, text by text: each text's different units as ``(row, unit, rank in the text)``, and every gap's rank."""
    rows = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])
    found, back = np.unique(rows * max(units, 1) + np.concatenate([*numbers, np.zeros(0, np.int64)]).astype(np.int64), return_inverse=True)
    row, unit = found // max(units, 1), found % max(units, 1)
    rank = np.arange(len(found)) - np.searchsorted(row, np.arange(len(numbers)))[row]
    return row, unit, rank, rank[back]


def text_key(text: str | None) -> tuple[bytes, int, int]:
    """A 128-bit digest of a text, and the 64 and 15 bits of it under which its units are asked for."""
    digest = xxhash.xxh3_128_digest((text or "").encode())
    return digest, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:10], "little") >> 1


def encode(docs: DataFrame, pieces: Pieces, out: str = "ids", check: str | None = None, frequent_limit: int = FREQUENT, keep_text: bool = True) -> DataFrame:
    """Adds the ids of every row's text (column ``text``) and, under the name ``check``, whether they decode to it.

    The check compares 128-bit digests. Without ``keep_text`` the text is left out and need not be shuffled.
    """
    docs = docs.drop(out, *([check] if check else []))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((pieces, *frequent_ids(docs, pieces, frequent_limit)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        gc.freeze()  # the word table need not be looked through again
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                texts = batch.column(0).slice(k, SLICE)
                numbers, units = encoder.gaps(texts)
                row, unit, rank, _ = ranked(numbers, len(units))
                keys = np.array([text_key(t)[1:] for t in texts.to_pylist()], np.int64).reshape(-1, 2)
                columns = [pa.array(units, pa.string()).take(pa.array(unit)), pa.array(keys[row, 0]), pa.array(rank + (keys[row, 1] << 32))]
                yield pa.RecordBatch.from_arrays(columns, ["unit", "key", "place"])

    # a unit's lattice is some forty times its row, so there are more and smaller parts than the rows alone would give
    parts = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = docs.select("text").mapInArrow(ask, "unit string, key bigint, place bigint").filter("unit is not null").repartition(parts, "unit")
    once = asked.distinct()
    # the filter above and the aggregates here keep the optimizer from making two shuffles of one: no other filter or pruning gets below
    units = asked.groupBy("unit").agg(F.max(F.length("unit")).alias("n"), F.max("place").alias("place"), F.max("key").alias("key")).filter("place >= 0 and key is not null").select("unit", "n")
    found = encoded_units(units, pieces)
    packed = pa.binary()

    answered = once.join(found, "unit").select(
        F.col("key").alias("_key"), F.shiftright("place", 32).cast("int").alias("_more"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"), "ids"
    )
    answers = answered.groupBy("_key", "_more").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("a"))
    answers = written(answers.select("_key", "_more", F.col("a.ids").alias("_answers")), "answered-units")

    kept = docs.columns if keep_text else [c for c in docs.columns if c != "text"]
    by_text = docs.select(*kept, F.col("text").alias("_text"))
    width = len(kept)
    gaps = T.StructType(
        [*(docs.schema[c] for c in kept)] + [T.StructField("_key", T.LongType()), T.StructField("_more", T.IntegerType()), T.StructField("_digest", T.BinaryType())]
        + [T.StructField("_packed", T.BinaryType()), T.StructField("_numbers", T.ArrayType(T.IntegerType())), T.StructField("_runs", T.ArrayType(T.IntegerType()))]
    )

    def leave_gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        gc.freeze()
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                keys = [text_key(t) for t in part.column(width).to_pylist()]
                packed_ids, numbers, runs, units = encoder.encode(part.column(width))
                places = pa.array(np.cumsum([0, *map(len, numbers)]), pa.int32())
                made = [
                    pa.array([x[1] for x in keys], pa.int64()), pa.array([x[2] for x in keys], pa.int32()), pa.array([x[0] for x in keys], packed), pa.array(packed_ids, packed),
                    pa.ListArray.from_arrays(places, pa.array(ranked(numbers, len(units))[3], pa.int32())), pa.array(runs, pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *made], gaps.names)

    joined = by_text.mapInArrow(leave_gaps, gaps).join(answers, ["_key", "_more"], "left").select(*kept, "_digest", "_packed", "_numbers", "_runs", "_answers")
    names_out = [*kept, out, *([check] if check else [])]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value[0], {}, {})
        decoder = Decoder(encoder.pieces)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                digests, *columns = (part.column(c).to_pylist() for c in range(width, width + 4))
                rows = [encoder.fill(*one) for one in zip(*columns, encoder.packed(part.column(width + 4)), strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows).astype(np.int32)))
                made = [ids]
                if check:
                    made.append(pa.array([xxhash.xxh3_128_digest(text) == digest for text, digest in zip(decoder.texts(ids), digests, strict=True)]))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *made], names_out)

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(check, T.BooleanType())] if check else [])])
    return joined.mapInArrow(put, schema)


class Decoder:
    """Pieces joined, byte pieces as UTF-8, marks as spaces, the first space dropped."""

    def __init__(self, pieces: Pieces):
        name = {i: p.replace(SPACE, " ").encode() for p, i in pieces.ids.items()} | {i: bytes([b]) for b, i in enumerate(pieces.byte_ids)}
        self.name = pa.array([name.get(i, b"") for i in range(max(name) + 1)], pa.binary())

    def texts(self, ids: pa.ListArray) -> list[bytes]:
        """The UTF-8 text of each list of ids."""
        out = pa.ListArray.from_arrays(np.r_[0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy())].astype(np.int32), self.name.take(ids.flatten()))
        return [text.removeprefix(b" ") for text in pc.binary_join(out, b"").to_pylist()]


def decode(df: DataFrame, pieces: Pieces, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of every row's ids."""
    shared = df.sparkSession.sparkContext.broadcast(pieces)

    @F.arrow_udf("string")
    def join(rows: pa.Array) -> pa.Array:
        texts = Decoder(shared.value).texts(rows)
        return pa.array([text.decode("utf-8", "replace") if known else None for text, known in zip(texts, rows.is_valid().to_pylist(), strict=True)], pa.string())

    return df.withColumn(out, join(F.col(ids)))


def encode_and_check(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """``ids`` and ``round_trip`` (whether the ids decode to the text; a null text counts as empty) in place of the text."""
    return encode(docs, pieces, check="round_trip", keep_text=False)


def default_pieces(spark: SparkSession, path: str | None = None) -> Pieces:
    """The pieces of the model file at ``path``, or of the public one that is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Pieces.load(path)
