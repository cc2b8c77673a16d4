"""SentencePiece encoding and decoding with N-best segmentation.

Over the lattice of a text's pieces a forward Viterbi pass gives, for every
position, the best score of what lies before it. Those scores are exact
heuristics for an A-star search that runs backward from the end and so yields
segmentations in the order of their scores. A text is cut into chunks that no
piece of the vocabulary crosses (checked when a model is loaded); the best
segmentations of a text are the best sums of its chunks' segmentations.

Short chunks that no cache remembers are searched many at once in numpy, by the same
passes: with exact heuristics the search for the best one never leaves its path, and the
best way left unfollowed beside that path is the next score. Chunks whose two best scores
are (almost) tied, or whose best path has characters outside the vocabulary, and long
chunks go to the heap.

The model file is a merge vocabulary: its scores only rank the pieces. As weights of the
lattice serve log-probabilities by the Zipf-Mandelbrot law over that rank, after the single
bytes; they add up to one over the vocabulary. The best path need not be the library's
merges; each row tells how many of its chunks are cut the same way, and
``encode_by_merges`` gives the library's own pieces.

Null texts count as empty: no pieces, one (empty) segmentation. A text with one
segmentation only has a null second score; of tied segmentations either may come first.
Rows are kept one for one, repeated or not; extra columns are ignored, whatever their
names. Texts are taken whole, a chunk at a time; a chunk of n characters takes memory in
proportion to n times the longest piece. The meta symbol U+2581 in a text decodes to a
space, as in the library. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, count, pairwise, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollsift.llm.common import documents, named, slices

MODEL = "piece_bpe_32k.model"
META = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks that a generation of the cache remembers (there are two), and the longest that is remembered.
CACHE, CACHED_CHARS = 300_000, 48
#: Chunks that are searched at once, text that is cut at once, and scores so near that the heap settles them.
TOGETHER, TEXT_BYTES, NEAR = 8192, 2 << 20, 1e-9
#: Letters, and whatever else is neither letter nor meta symbol, each with the meta symbols before it.
CHUNK = re.compile(rf"{META}*[^\W\d_¹²³]+|{META}*(?:[^\w{META}]|[\d_¹²³])+|{META}+")


class Model(dict):
    """A piece vocabulary; as a dict it remembers what the searches of short chunks gave.

    A full cache becomes the older generation, from which a chunk comes back when it is
    met again, so rare chunks go and frequent ones stay. Workers live on between the
    stages of a pipeline, with whatever is remembered here.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}
        of_byte = {i: b for b, i in self.byte.items()}
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.sp, self.older = sp, {}
        self.break_ids = len(sp.encode("\n"))
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)), 1 + len(self.byte))}
        total = math.log(sum(1 / r for r in rank.values()))
        self.score = {i: -math.log(r) - total for i, r in rank.items()}
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        self.unk_id = sp.unk_id()
        self.surface = [bytes([of_byte[i]]) if i in of_byte else sp.id_to_piece(i).encode() if i in self.score else b"" for i in ids]
        pieces = {sp.id_to_piece(i): i for i in plain}
        self.chunked = all(len(CHUNK.findall(p)) == 1 for p in pieces)
        self.trie: dict = {}
        for piece, i in pieces.items():
            node = self.trie
            for c in piece[:-1]:
                node = node.setdefault(c, [None, {}])[1]
            node.setdefault(piece[-1], [None, {}])[0] = (i, self.score[i])
        self.tables()

    def tables(self) -> None:
        """The trie as arrays: sorted keys of (node, character), and for each the node there and its piece or -1."""
        entries, waiting, nodes = [], [(0, self.trie)], 1
        while waiting:
            number, node = waiting.pop()
            for c, (piece, below) in node.items():
                entries.append((number << 21 | ord(c), nodes, -1 if piece is None else piece[0]))
                waiting.append((nodes, below))
                nodes += 1
        keys, self.child, self.piece = (np.array(x) for x in zip(*sorted(entries), strict=True))
        self.keys = np.append(keys, 1 << 62)
        self.opening = np.full(0x110000, len(keys), np.int32)  # the root's keys by character
        self.opening[keys[keys < 1 << 21]] = np.arange((keys < 1 << 21).sum())
        self.scores = np.array([self.score.get(i, self.unknown) for i in range(self.sp.get_piece_size())])

    def __missing__(self, chunk: str) -> bytes:
        """16 bytes and the best ids: the best score, and the loss of the second best or infinity, negative (also
        -0.0) where the library cuts the chunk in another way. One object, as a tuple takes three times the memory."""
        found = self.older.get(chunk)
        if found is None:
            search = self.segmentations(chunk, 1)
            score, ids, bound = next(search)
            lost = math.copysign(max(0.0, score - bound), 1 if self.merged(chunk) == list(ids) else -1)
            found = array("d", (score, lost)).tobytes() + array("i", ids).tobytes()
        if len(chunk) <= CACHED_CHARS:
            self.remember(chunk, found)
        return found

    def remember(self, chunk: str, found: bytes) -> None:
        if len(self) >= CACHE:
            self.older = self.copy()
            self.clear()
        self[chunk] = found

    def learn(self, texts: list[list[str]]) -> None:
        """Search the short chunks of these texts that aren't remembered, many at once."""
        unseen = [c for c in set().union(*texts).difference(self) if len(c) <= CACHED_CHARS and c not in self.older]
        for at in range(0, len(unseen), TOGETHER):
            part = unseen[at : at + TOGETHER]
            for chunk, found in zip(part, self.searched(part), strict=True):
                if found is not None:
                    self.remember(chunk, found)

    def lattices(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """The lattices of chunks that aren't empty, one after the other, each with one position more than
        characters: start, end, piece (-1: none) and score of every edge, those with the same end side by side,
        lower ends of their chunk first; how many characters of the chunk lie before the end; and each chunk's last position."""
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        stop = np.cumsum(size)
        chunk = np.repeat(np.arange(len(chunks)), size)
        at, node, single, edges, depth = np.arange(len(code)), None, np.zeros(len(code), bool), [], 0
        while len(at):
            if depth:
                key = node << 21 | code[at + depth]
                found = np.searchsorted(self.keys, key)
                there = self.keys[found] == key
            else:
                found = self.opening[code]
                there = found < len(self.child)
            at, found = at[there], found[there]
            node, piece = self.child[found], self.piece[found]
            whole = piece >= 0
            if not depth:
                single[at[whole]] = True
            depth += 1
            edges.append((at[whole], at[whole] + depth, piece[whole]))
            inside = at + depth < stop[chunk[at]]
            at, node = at[inside], node[inside]
        alone = np.flatnonzero(~single)
        edges.append((alone, alone + 1, np.full(len(alone), -1)))
        start, end, piece = map(np.concatenate, zip(*edges, strict=True))
        of = chunk[start]
        height = end - (stop - size)[of]
        order = np.argsort(height * len(code) + end - 1)
        start, end, piece = (start + of)[order], (end + of)[order], piece[order]
        return start, end, piece, np.where(piece < 0, self.unknown, self.scores[piece]), height[order], stop + np.arange(len(chunks))

    def searched(self, chunks: list[str]) -> list[bytes | None]:
        """What ``__missing__`` gives for each of these chunks, none of them empty; None is left to it."""
        start, end, piece, gain, height, last = self.lattices(chunks)
        group = np.flatnonzero(np.diff(end, prepend=-1))  # edges that end in one position
        many, group_of = np.diff(group, append=len(end)), np.zeros(last[-1] + 1, np.int64)
        group_of[end[group]] = np.arange(len(group))
        # forward Viterbi, for all chunks from one position to the next
        ahead, levels = np.zeros(last[-1] + 1), np.arange(1, height[-1] + 2)
        for (a, g), (b, h) in pairwise(zip(np.searchsorted(height, levels), np.searchsorted(height[group], levels), strict=True)):
            ahead[end[group[g:h]]] = np.maximum.reduceat(ahead[start[a:b]] + gain[a:b], group[g:h] - a)
        # backward along the best ways; ``left`` is the best way not followed
        score, left, whole = np.zeros(len(chunks)), np.full(len(chunks), -np.inf), np.ones(len(chunks), bool)
        at, going, steps = last.copy(), np.arange(len(chunks)), []
        opening = last - np.fromiter(map(len, chunks), np.int64, len(chunks))
        while len(going):
            g = group_of[at[going]]
            n = many[g]
            first = np.cumsum(n) - n
            edge = np.arange(n.sum()) + np.repeat(group[g] - first, n)
            behind = np.repeat(score[going], n) + gain[edge]
            total = ahead[start[edge]] + behind
            top = np.maximum.reduceat(total, first)
            hit = np.flatnonzero(total == np.repeat(top, n))
            hit = hit[np.searchsorted(hit, first)]  # the first of equal ones
            total[hit] = -np.inf
            left[going] = np.maximum(left[going], np.maximum.reduceat(total, first))
            edge = edge[hit]
            score[going], at[going] = behind[hit], start[edge]
            whole[going] &= piece[edge] >= 0
            steps.append((going, piece[edge]))
            going = going[at[going] > opening[going]]
        of, ids = map(np.concatenate, zip(*reversed(steps), strict=True))
        order = np.argsort(of, kind="stable")
        of, ids = of[order], ids[order].astype(np.int32)
        lost = score - left
        settled = whole & (lost > NEAR)
        agreed = self.agreed(chunks, of, ids)
        heads = np.stack((score, np.where(agreed, lost, -lost)), 1).tobytes()
        ends = (4 * np.cumsum(np.bincount(of, minlength=len(chunks)))).tolist()
        raw = ids.tobytes()
        return [heads[16 * i : 16 * i + 16] + raw[a:b] if ok else None for i, (a, b, ok) in enumerate(zip([0, *ends], ends, settled.tolist()))]

    def agreed(self, chunks: list[str], of: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether the library cuts each chunk into these ids (``of``: the chunk of each id)."""
        feed = self.sp.encode("\n")[-1]
        joined = ["\n" + "\n".join(chunks[i : i + 64]).replace(META, " ") for i in range(0, len(chunks), 64)]  # short texts merge faster
        found = self.sp.encode(joined, num_threads=1)
        theirs = np.array([*chain.from_iterable(x[self.break_ids - 1 :] for x in found)], np.int32)
        breaks = np.flatnonzero(theirs == feed)
        at = np.fromiter((1 + c.count("\n") for c in chunks), np.int64, len(chunks)).cumsum()  # chunks may have line breaks themselves
        if len(breaks) == at[-1]:
            before = breaks[np.concatenate(([0], at[:-1]))]
            n = np.diff(before, append=len(theirs)) - 1
            theirs = np.delete(theirs, before)
        else:
            merged = [self.merged(c) for c in chunks]
            theirs = np.array([*chain.from_iterable(merged)], np.int32)
            n = np.fromiter(map(len, merged), np.int64, len(chunks))
        same = n == np.bincount(of, minlength=len(chunks))
        mine, differs = same[of], np.zeros(len(chunks), bool)
        compared = of[mine]
        differs[compared[ids[mine] != theirs[np.repeat(same, n)]]] = True
        return same & ~differs

    def merged(self, chunk: str) -> list[int]:
        """The library's pieces of a chunk: no merge crosses a line break, so one keeps off the prefix of a text."""
        return self.sp.encode("\n" + chunk.replace(META, " "))[self.break_ids :]

    def lattice(self, chunk: str) -> tuple[list, list]:
        """Forward Viterbi: best score before each position, and the pieces that end there."""
        n = len(chunk)
        ahead, ending = [float("-inf")] * (n + 1), [[] for _ in range(n + 1)]
        ahead[0] = 0.0
        for i in range(n):
            node, j, single, here = self.trie, i, False, ahead[i]
            while j < n and (at := node.get(chunk[j])) is not None:
                j += 1
                if at[0] is not None:
                    single = single or j == i + 1
                    k, s = at[0]
                    ending[j].append((i, s, k))
                    if here + s > ahead[j]:
                        ahead[j] = here + s
                node = at[1]
            if not single:
                ending[i + 1].append((i, self.unknown, -1 - ord(chunk[i])))
                ahead[i + 1] = max(ahead[i + 1], here + self.unknown)
        return ahead, ending

    def segmentations(self, chunk: str, n: int) -> Iterator[tuple[float, tuple[int, ...], float]]:
        """The n best segmentations of a chunk, best first, by backward A-star: (score, ids, score of the next).

        The heuristics are exact, so the top of the heap, or a way left unfollowed above
        it, tells the next score before its path is followed; it is minus infinity after
        the last.
        """
        ahead, ending = self.lattice(chunk)
        order, visits, most, left = count(), [0] * (len(chunk) + 1), n, float("-inf")
        heap = [(-ahead[-1], next(order), len(chunk), 0.0, None)]
        while heap and n:
            lower, _, at, behind, path = heappop(heap)
            visits[at] += 1
            if visits[at] > most:  # no further way from here can be among the n best, but it may be the next
                left = max(left, -lower)
                continue
            if not at:
                n -= 1
                yield behind, self.ids(path), max(left, -heap[0][0]) if heap else left
                continue
            for start, s, piece in ending[at]:
                g = behind + s
                heappush(heap, (-(ahead[start] + g), next(order), start, g, (piece, path)))

    def ids(self, path) -> tuple[int, ...]:
        out: list[int] = []
        while path is not None:
            piece, path = path
            if piece >= 0:
                out.append(piece)
            elif self.byte:
                out.extend(self.byte[b] for b in chr(-1 - piece).encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unk_id)
        return tuple(out)

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        marked = META + text.replace(" ", META)
        return CHUNK.findall(marked) if self.chunked else [marked]

    def nbest(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text as (score, ids), best first."""
        best: list[tuple[float, tuple]] = [(0.0, ())]
        for chunk in self.chunks(text):
            options = [*self.segmentations(chunk, n)]
            sums = ((a + s, (path, ids)) for a, path in best for s, ids, _ in options)
            best = sorted(sums, key=lambda x: -x[0])[:n]
        out = []
        for score, path in best:
            parts = []
            while path:
                path, ids = path
                parts.append(ids)
            out.append((score, [i for ids in reversed(parts) for i in ids]))
        return out

    def decode(self, ids) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace").replace(META, " ")
        return raw[1:] if raw[:1] == " " else raw


@lru_cache(maxsize=4)
def model(name: str) -> Model:
    return Model(public_tokenizers.path(name))


SCHEMA = "doc_id long, ids array<int>, second_ids array<int>, best_score double, second_score double, round_trip boolean, n_chunks long, n_merged long"


def encode_documents(docs: DataFrame, model_name: str = MODEL) -> DataFrame:
    """(doc_id, text) -> the ids and scores of the two best segmentations of each whole
    text, whether decoding the best gives the text again, its chunks and those that the
    library cuts the same way. Without a shuffle."""

    def one(m: Model, text: str, chunks: list[str]) -> tuple:
        if not chunks:
            return np.zeros(0, np.int32), None, 0.0, None, True, 0, 0
        found = [*map(m.__getitem__, chunks)]
        flat = np.frombuffer(b"".join(found), np.int32)
        end = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) >> 2
        head = np.concatenate(([0], end[:-1]))[:, None] + np.arange(4)
        heads, is_id = flat[head].view(np.float64), np.ones(len(flat), bool)
        is_id[head] = False
        ids, lost = flat[is_id], np.abs(heads[:, 1])
        score, at = float(sum(heads[:, 0].tolist())), int(np.argmin(lost))
        second = None
        if lost[at] < float("inf"):  # the second best differs in the chunk that loses least by it
            other = np.array([*m.segmentations(chunks[at], 2)][1][1], np.int32)
            after = int(end[at]) - 4 * (at + 1)
            second = np.concatenate((ids[: after - (len(found[at]) >> 2) + 4], other, ids[after:]))
        back = m.decode(ids.tolist()) == text.replace(META, " ")
        return ids, second, score, None if second is None else score - float(lost[at]), back, len(chunks), len(chunks) - int(np.signbit(heads[:, 1]).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_name)
        for batch in batches:
            for part in slices(batch, TEXT_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                chunks = [*map(m.chunks, texts)]
                m.learn(chunks)
                rows = [*map(one, repeat(m), texts, chunks)]
                columns = zip(*rows, strict=True)
                arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64())
    return named(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def encode_by_merges(docs: DataFrame, model_name: str = MODEL) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids): the pieces that the library's merges give. Without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = model(model_name).sp
        for batch in batches:
            ids = [sp.encode(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return named(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_name: str = MODEL) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_name)
        for batch in batches:
            texts = [None if x.as_py() is None else m.decode(x.as_py()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return named(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(encoded: DataFrame) -> DataFrame:
    """The rows of op8: counts, scores and SHA-256 of the ids, comma-joined; without a second segmentation its columns are null."""
    sha = lambda c: F.sha2(F.array_join(c, ","), 256)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        "best_score",
        "second_score",
        F.size("second_ids").cast("long").alias("n_second_pieces"),
        sha("ids").alias("ids_sha256"),
        sha("second_ids").alias("second_sha256"),
        "round_trip",
        "n_chunks",
        "n_merged",
    )


def op8_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode_documents(documents(spark, sf_dir)))
