"""Alignment of two tokenizers' tokens over the same bytes, in relations.

Tokens of both sides are rows of a block's columns; a running sum of byte lengths says where each begins and
ends, and an equi-join of both sides on that place finds the cuts, where tokens of both end.
A running count of cuts numbers the groups. Between two consecutive places exactly one token of either side
lies over the bytes, so the joined rows, each with the last token of either side, are the links.

Texts are put together from cells: a cell begins at a blank between two `SOLID` characters, where both
tokenizers always cut (their vocabularies are checked for it at the start), so a cell has the same tokens and groups in
every text. Documents are read in blocks, where they lie; the distinct cells of a block are encoded and aligned
once, and documents then add up their cells' rows. No text is shuffled. A pair's count is the number of documents that
hold it linked: blocks count their own, which are summed over the corpus and go back to the blocks that
hold the pair, so no key's rows grow beyond one a block. They go back by a hash join while their number allows
to send them everywhere (`PAIRS`), else by a shuffle. Between the two passes a block keeps its
documents as numbers of cells, and its cells as numbers of pairs, compressed.

Edge cases: texts null, empty or changed by a tokenizer (joined bytes differ) have no tokens: zeros, ''
instead of a digest, and they count for no pair; texts and cells are taken whole, however long; equal rows
get equal results and count apart; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.scan import slices
from gristmill.runtime import cut, ship, small_side, spread

ship(__name__)
ship("gristmill.llm.scan")

#: Characters between which a blank begins a cell: none is white space for either tokenizer.
SOLID = "[!-~¡-¬®-˿Ͱ-ԯぁ-ヿ一-鿿가-힣]"
CELLS = f"(?<={SOLID})(?= {SOLID})"
# Fixed value: how byte-level BPE cuts a text into pieces before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# End of fixed value.
#: Distinct pairs up to which their counts are broadcast (about 40 bytes each).
PAIRS = 2_000_000
#: Characters of text in a block, and cells that are encoded at a time.
BLOCK, CHUNK = 32_000_000, 20_000
#: A pair's number: the id of A times this, plus the id of B.
SECOND = 1 << 20
#: A token in an array: its id, and from this bit on its bytes.
LENGTH_BIT = 17
#: What a block keeps: `packed`, its documents with their cells' numbers, and the cells' links; its pairs, and how many of its documents hold each.
BLOCKS = "block long, docs binary, links binary, pairs array<long>, held array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Both:
    """Encoders of both tokenizers for cells, with the bytes of every token."""

    def __init__(self, a_json: str, b_model: bytes):
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        from gristmill.llm.bpe import byte_letters

        spec = Tokenizer.from_str(a_json)
        self.b = SentencePieceProcessor(model_proto=b_model)
        byte = {c: i for i, c in enumerate(byte_letters())}
        special = {t.content for t in spec.get_added_tokens_decoder().values() if t.special}  # their strings in a text are text
        ranks = {bytes(byte[c] for c in t): i for t, i in spec.get_vocab(with_added_tokens=True).items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})  # the file's vocabulary: ids are in the order of its merges
        self.a_bytes = {i: t for t, i in ranks.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.a_lengths, self.b_lengths = (np.array([len(t.get(i, b"")) for i in range(max(t) + 1)], np.int64) for t in (self.a_bytes, self.b_bytes))
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("cells need a piece vocabulary without pieces over a blank")

    def encode(self, cells: list[str]) -> pa.StructArray:
        """Tokens of each cell on either side, a and b: none where a tokenizer changes it."""
        raw = [c.encode() for c in cells]
        sizes = np.array([*map(len, raw)], np.int64)
        fine, sides = np.ones(len(raw), bool), []
        for ids, known, lengths in (([*map(self.a.encode_ordinary, cells)], self.a_bytes, self.a_lengths), (self.b.encode([c[1:] for c in cells], num_threads=1), self.b_bytes, self.b_lengths)):
            ptr = np.concatenate([[0], np.cumsum([*map(len, ids)])]).astype(np.int64)
            flat = [*chain.from_iterable(ids)]
            tokens = np.array(flat, np.int64)
            own = added(ptr, lengths[tokens])
            said = b"".join(map(known.__getitem__, flat))
            if (own != sizes).any() or said != b"".join(raw):
                fine &= (own == sizes) & [said[e - n : e] == r for r, n, e in zip(raw, own.tolist(), np.cumsum(own).tolist())]
            sides.append((ptr, tokens, lengths))
        out = [lists(np.where(fine, np.diff(ptr), 0), (tokens | lengths[tokens] << LENGTH_BIT)[np.repeat(fine, np.diff(ptr))]) for ptr, tokens, lengths in sides]
        return pa.StructArray.from_arrays(out, names=["a", "b"])


def cells_of(text: str | None) -> list[str]:
    return re.split(CELLS, " " + text) if text else []


def ragged(ptr: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the values of `rows`, whose values begin at `ptr`, one row after the other."""
    sizes = ptr[rows + 1] - ptr[rows]
    return np.repeat(ptr[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def added(ptr: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values of each row."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[ptr[1:]] - sums[ptr[:-1]]


def lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def rows_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row of a column of lists begins, and the values."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    return whole.offsets.to_numpy(), whole.values.to_numpy()


def packed(**columns) -> bytes:
    batch = pa.record_batch({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


@dataclass
class Cells:
    """Cells aligned: tokens of either side, groups and links of each, and a's and b's ids group by group as text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    #: Where each cell's links begin, and the links as pairs' numbers.
    ptr: np.ndarray
    pairs: np.ndarray
    ids: list[str]


def places(coded: pa.StructArray) -> Cells:
    """`Cells` of tokens: every place where a token begins is a row.

    A cell has equally many bytes on either side, so the running sums over all cells say where a token lies on both.
    """
    ids, begins, firsts, counts = [], [], [], []
    for side in ("a", "b"):
        lists = coded.field(side)
        at, tokens = lists.offsets.to_numpy(), lists.values.to_numpy()
        tokens = tokens[at[0] : at[-1]]
        ends = np.concatenate([[0], np.cumsum(tokens >> LENGTH_BIT, dtype=np.int64)])
        ids.append(tokens & (1 << LENGTH_BIT) - 1)
        begins.append(ends[:-1])
        firsts.append(ends[at - at[0]])  # the byte where each cell begins, and the end
        counts.append(np.diff(at))
    rows = np.union1d(*begins)
    over = [np.searchsorted(b, rows, "right") - 1 for b in begins]
    both = np.ones(len(rows), np.int64)
    for b, o in zip(begins, over):
        both &= b[o] == rows
    so_far = np.cumsum(both)
    ptr = np.searchsorted(rows, firsts[0])
    pairs = ids[0][over[0]].astype(np.int64) * SECOND + ids[1][over[1]]
    return Cells(*counts, added(ptr, both), ptr, pairs, listed(ids, [so_far[np.searchsorted(rows, b)] for b in begins], counts))


def listed(ids: list[np.ndarray], groups: list[np.ndarray], counts: list[np.ndarray]) -> list[str]:
    """Of each cell its groups' ids, `a1,a2|b1;...`."""
    token, group, side = np.concatenate(ids), np.concatenate(groups), np.repeat([0, 1], [len(x) for x in ids])
    order = np.argsort(group * 2 + side, kind="stable")
    token, group, side = token[order], group[order], side[order]
    then = np.where(np.diff(group, append=-1) != 0, ";", np.where(np.diff(side, append=-1) != 0, "|", ",")).astype(object)
    names, number = np.unique(token, return_inverse=True)
    parts = (np.array([str(x) for x in names.tolist()], object)[number] + then).tolist() if len(token) else []
    ends = np.cumsum(counts[0] + counts[1]).tolist()
    return ["".join(parts[a:b])[:-1] for a, b in zip([0, *ends], ends)]


class Block:
    """Documents read so far, as numbers of the distinct cells."""

    def __init__(self):
        self.size, self.doc_ids, self.sizes = 0, [], []
        self.number: dict[str, int] = {}
        self.cells = array("i")

    def add(self, doc_id: int | None, text: str | None) -> None:
        cells, number = cells_of(text), self.number
        self.cells.extend([number.setdefault(c, len(number)) for c in cells])
        self.doc_ids.append(doc_id)
        self.sizes.append(len(cells))
        self.size += len(text or "")

    def aligned(self, both: Both) -> Cells:
        names = list(self.number)
        parts = [places(both.encode(names[at : at + CHUNK])) for at in range(0, len(names) or 1, CHUNK)]
        ptr = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.ptr) for p in parts]))]).astype(np.int64)
        return Cells(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("n_a", "n_b", "n_groups")), ptr, np.concatenate([p.pairs for p in parts]), [x for p in parts for x in p.ids])

    def row(self, block: int, both: Both) -> pa.RecordBatch:
        """The block as a row of `BLOCKS`."""
        known = self.aligned(both)
        ptr = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        cells = np.frombuffer(self.cells, np.int32)
        void = (ptr[1:] == ptr[:-1]) | (added(ptr, known.n_a[cells] == 0) > 0)
        pairs, link = np.unique(known.pairs, return_inverse=True)
        held = np.zeros(len(pairs), np.int32)
        digests = []
        for at, end, none in zip(ptr.tolist(), ptr[1:].tolist(), void.tolist()):
            own = cells[at:end]
            digests.append("" if none else hashlib.sha256(";".join(map(known.ids.__getitem__, own.tolist())).encode()).hexdigest())
            if not none:
                held[np.unique(link[ragged(known.ptr, np.unique(own))])] += 1
        sums = {n: np.where(void, 0, added(ptr, v[cells])) for n, v in (("n_a", known.n_a), ("n_b", known.n_b), ("n_groups", known.n_groups), ("n_links", np.diff(known.ptr)))}
        docs = packed(doc_id=pa.array(self.doc_ids, pa.int64()), **sums, groups_sha256=digests, cells=lists(np.where(void, 0, np.diff(ptr)), cells[np.repeat(~void, np.diff(ptr))]))
        links = packed(links=lists(np.diff(known.ptr), link))
        row = ([block], pa.int64()), ([docs], pa.binary()), ([links], pa.binary()), ([pairs], pa.list_(pa.int64())), ([held], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(*x) for x in row], names=[x.split()[0] for x in BLOCKS.split(", ")])


def blocks_of(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """`BLOCKS` of `docs`, where these lie."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        source = (f.read(), g.read())
    Both(*source)  # fails here, not in a task
    shared = docs.sparkSession.sparkContext.broadcast({"source": source})

    def run(batches):
        here = shared.value  # one object per Python worker
        both = here["both"] = here.get("both") or Both(*here["source"])
        block, number = Block(), TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                block.add(doc_id, text)
                if block.size >= BLOCK:
                    yield block.row(number, both)
                    block, number = Block(), number + 1
        if block.doc_ids:
            yield block.row(number, both)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCKS)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, n_docs, best: how many documents hold the pair linked, and whether no pair of that A has more."""
    counts = pairs.groupBy("pair").agg(F.sum("held").alias("n_docs"))
    best = F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a"))
    return counts.withColumn("a", F.expr(f"pair div {SECOND}")).select("pair", "n_docs", best.alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """`RESULT` for every row of `docs` (doc_id, text)."""
    blocks = cut(blocks_of(spread(docs.select("doc_id", "text")), a_path, b_path))
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x")).select(F.col("block").alias("at_block"), "place", "x.*").withColumnRenamed("pairs", "pair")
    counts = cut(pair_counts(pairs))
    found = pairs.drop("held").join(small_side(counts, counts.count(), PAIRS), "pair").select("at_block", "place", "n_docs", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        out = []
        for row in left.select(["docs", "links"]).to_pylist():
            docs, links = unpacked(row["docs"]), unpacked(row["links"])
            (of_cell, link), (of_doc, cell) = rows_of(links.column("links")), rows_of(docs.column("cells"))
            told = docs.drop_columns(["cells"])
            for name, kind in (("count_sum", "n_docs"), ("n_best", "best")):
                values = np.zeros(len(place), np.int64)
                values[place] = right.column(kind).to_numpy()
                told = told.append_column(name, pa.array(added(of_doc, added(of_cell, values[link])[cell])))
            out.append(told.select([x.split()[0] for x in RESULT.split(", ")]))
        return pa.concat_tables(out)

    parts = max(2, blocks.count())
    return blocks.select("block", "docs", "links").repartition(parts, "block").groupBy("block").cogroup(found.groupBy("at_block")).applyInArrow(run, RESULT)
