"""SentencePiece encoding with seeded merge-dropout, and decoding.

Words (a space and what follows it up to the next one, so runs of spaces are
never one piece) are merged as the model
says: the agenda holds all neighbouring pieces whose union is a piece, and the
one of the best score, leftmost first, is merged next.  When a candidate comes
up it is skipped for good if a hash falls below ``dropout``.  The hash is keyed
by the seed, the document, its copy, the place of the word in the document, and
the candidate's place and piece.  So a document is always cut alike, but each
place where a word stands has draws of its own, and every segmentation spells
the same text.

What a skip does to a word depends on the word alone, so what most places need is
worked out once and kept: a *run* is the agenda of a word with one candidate skipped
or none, its merges in the order they came up, and the ids it ends in.  A place starts
with the run without skips, draws for its merges, and goes on with the run that skips
the first one drawn; if a merge of that is drawn too, its agenda is worked out for
itself.  Agendas go side by side: each step takes the best candidate of every word
that has one left.  Words of more than ``LONG`` symbols have a heap for an agenda.

Decoding is lossless: characters the model lacks, the sign that stands for a
space (U+2581) where the text itself holds it, and what the model would
normalise are spelt in byte pieces.

Cases: null and empty texts have no ids and decode to an empty text; rows are
encoded one by one, so repeated rows of one copy number give equal ids (``numbered_copies``
numbers them); a null doc_id is an id of its own; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import heapq
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import fresh, from_columns, mix64, schema_with, slices, tidy

SPACE = "▁"
NONE = np.int64(-1)
#: Symbols beyond which a word's agenda is a heap; the ids are the same either way.
LONG = 128
#: Places whose draws are held at a time.
PLACES = 200_000


def _salt(at: np.ndarray, middle: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """A number for a candidate: where its two pieces begin in the word, and what they make."""
    with np.errstate(over="ignore"):
        return mix64(mix64((at.astype(np.uint64) << np.uint64(32)) + middle.astype(np.uint64)) + piece.astype(np.uint64))


class PieceModel:
    """Pieces of a merge-type model with byte pieces, and segmentations with dropout."""

    def __init__(self, path: str, seed: int, dropout: float, memory: int = 4_000_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.seed, self.memory = seed, memory
        self.limit = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.score = np.array([model.get_score(i) for i in range(n)])
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.byte_of = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.number = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if len(self.byte_of) != 256:
            raise ValueError("the model has no byte pieces")
        # bytes that each id stands for, in one array
        spelt = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_size = np.array([len(x) for x in spelt], np.int64)
        self.spelt_at = np.cumsum(self.spelt_size) - self.spelt_size
        # all ways to put a piece together of two
        merges = {}
        for piece, i in self.number.items():
            for cut in range(1, len(piece)):
                left, right = self.number.get(piece[:cut]), self.number.get(piece[cut:])
                if left is not None and right is not None:
                    merges[left * n + right] = i
        self.n = n
        self.merges = merges
        self._table(merges)
        self.rank = np.empty(n, np.int64)  # 0 is merged first
        self.rank[np.lexsort((np.arange(n), -self.score))] = np.arange(n)
        self.by_rank = np.argsort(self.rank)
        self._forget()

    def _table(self, merges: dict[int, int]) -> None:
        """A hash table of pairs with open addressing, filled in rounds."""
        size = 1 << (len(merges) * 4).bit_length()
        self.mask = np.int64(size - 1)
        self.pair, self.merged = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        keys, values = np.fromiter(merges.keys(), np.int64, len(merges)), np.fromiter(merges.values(), np.int64, len(merges))
        self.probes, step = 0, np.int64(0)
        while len(keys):
            at = (self._slot(keys) + step) & self.mask
            free = self.pair[at] < 0
            _, first = np.unique(at, return_index=True)
            put = np.zeros(len(keys), bool)
            put[first] = True
            put &= free
            self.pair[at[put]], self.merged[at[put]] = keys[put], values[put]
            keys, values = keys[~put], values[~put]
            step += 1
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.view(np.uint64)) & np.uint64(self.mask)).view(np.int64)

    def union(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two pieces make, or -1."""
        out = np.full(len(left), NONE)
        keys = left * self.n + right
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._slot(keys[todo])
        for _ in range(self.probes):
            found = self.pair[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.merged[at[hit]]
            more = ~hit & (found >= 0)
            todo, at = todo[more], (at[more] + 1) & self.mask
            if not len(todo):
                break
        return out

    def _forget(self) -> None:
        """Drop all runs.  A run's ids and merges (as salts) lie one after the other in ``ids`` and ``salts``."""
        self.roots: dict[str, int] = {}
        self.children: dict[int, int] = {}
        self.word: list[str] = []
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.first, self.steps, self.salts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def characters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First pieces of all words, and the offsets of the words: characters that are pieces, or bytes (no merge takes those)."""
        text = "".join(words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        # the first character of a word is the space that it begins with, whatever it may look like
        unique, inverse = np.unique(code, return_inverse=True)
        spelt: list[list[int]] = []
        for c in unique.tolist():
            char = chr(c)
            number = None if char == SPACE else self.number.get(SPACE if char == " " else char)
            spelt.append([number] if number is not None else [self.byte_of[b] for b in char.encode("utf-8", "surrogatepass")])
        many = np.array([len(x) for x in spelt], np.int64)
        flat = np.array([i for x in spelt for i in x], np.int64)
        first = np.cumsum(many) - many
        count = many[inverse] if len(many) else np.zeros(0, np.int64)
        total = np.cumsum(count)
        ids = flat[np.repeat(first[inverse] - (total - count), count) + np.arange(total[-1])] if len(code) else np.zeros(0, np.int64)
        per_word = np.bincount(owner, weights=count, minlength=len(words)).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(per_word)))

    def segment(self, words: list[str], skip: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, where the candidate of salt ``skip`` (0: none) and those that ``keys`` draw are skipped; the offsets of the words,
        the salts of all merges, and per word where its own begin and how many they are."""
        ids, offsets = self.characters(words)
        size = np.diff(offsets)
        out = ids.copy()
        live = np.ones(len(ids), bool)  # whether a piece begins here
        # words of like size go together, as rows of a table
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 1]
        start, salts, total = 0, [np.zeros(0, np.uint64)], 0
        first, steps = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        while start < len(order):
            width = int(size[order[start]])
            stop = int(np.searchsorted(size[order], max(width + width // 4, width), side="right"))
            stop = min(stop, start + max(1, min(400_000 // width, 1 << 16)))
            rows = order[start:stop]
            width = int(size[rows[-1]])
            at = offsets[rows][:, None] + np.arange(width)[None, :]
            inside = np.arange(width)[None, :] < size[rows][:, None]
            table = np.where(inside, ids[np.minimum(at, len(ids) - 1)], NONE)
            table, which, salt = self._merge(table, skip[rows], None if keys is None else keys[rows])
            out[at[inside]], live[at[inside]] = table[inside], table[inside] != NONE - 1
            own = np.bincount(which, minlength=len(rows))
            first[rows], steps[rows] = total + np.cumsum(own) - own, own
            salts.append(salt[np.argsort(which.astype(np.uint16), kind="stable")])
            total += len(salt)
            start = stop
        per_word = np.concatenate(([0], np.cumsum(live)))[offsets]
        return out[live].astype(np.int32), per_word, np.concatenate(salts), first, steps

    def _candidates(self, skip: np.ndarray, key: np.ndarray | None, left: np.ndarray, right: np.ndarray, at: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the unions of pieces at ``at`` and ``middle`` of their words (a large number without one, or where it is skipped), and their salts."""
        piece = self.union(left, right)
        rank = np.where(piece >= 0, self.rank[piece], self.n)
        salt = _salt(at, middle, piece)
        rank[salt == skip] = self.n
        if key is not None:
            rank[self._skipped(key, salt)] = self.n
        return rank, salt

    def _merge(self, table: np.ndarray, skip: np.ndarray, key: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of pieces, merged (a place that its left neighbours took holds -2), and the rows and salts of the merges, in order."""
        height, width = table.shape

        def offer(r: np.ndarray, at: np.ndarray, middle: np.ndarray) -> None:
            rank[r, at], salt[r, at] = self._candidates(skip[r], None if key is None else key[r], table[r, at], table[r, middle], at, middle)

        table = table.copy()
        after = np.tile(np.arange(1, width + 1), (height, 1))  # where the next piece begins
        before = np.tile(np.arange(-1, width - 1), (height, 1))
        rank, salt = np.full((height, width), self.n), np.zeros((height, width), np.uint64)  # of the union with the next piece
        if width > 1:
            r, c = np.nonzero((table[:, :-1] >= 0) & (table[:, 1:] >= 0))
            offer(r, c, c + 1)
        active = np.arange(height)
        rows, salts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        while len(active):
            best = rank[active].argmin(axis=1)
            value = rank[active, best]
            more = value < self.n
            active, best, value = active[more], best[more], value[more]
            if not len(active):
                break
            rows.append(active)
            salts.append(salt[active, best])
            gone = after[active, best]
            table[active, best], table[active, gone] = self.by_rank[value], NONE - 1
            nxt = after[active, gone]
            after[active, best] = nxt
            rank[active, gone] = self.n
            rank[active, best] = self.n
            ok = nxt < width
            before[active[ok], nxt[ok]] = best[ok]
            ok &= table[active, np.minimum(nxt, width - 1)] >= 0
            offer(active[ok], best[ok], nxt[ok])
            prev = before[active, best]
            ok = prev >= 0
            offer(active[ok], prev[ok], best[ok])
        return table, np.concatenate(rows), np.concatenate(salts)

    def segment_long(self, word: str, key: int) -> list[int]:
        """Ids of one word with the draws of ``key``; the agenda is a heap."""
        ids = self.characters([word])[0]
        n, limit = len(ids), int(self.limit)
        left, right = np.arange(max(n - 1, 0)), np.arange(1, n)
        piece = self.union(ids[:-1], ids[1:])
        ok = piece >= 0
        ok &= ~self._skipped(np.uint64(key), _salt(left, right, piece))
        agenda = [(int(self.rank[piece[i]]), i, i + 1, int(piece[i])) for i in np.flatnonzero(ok).tolist()]
        heapq.heapify(agenda)
        ids = ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, one = self.rank.tolist(), np.zeros(1, np.int64)

        def offer(at: int, middle: int) -> None:
            found = self.merges.get(ids[at] * self.n + ids[middle])
            if found is not None and not (limit and self._skipped(np.uint64(key), _salt(one + at, one + middle, one + found))[0]):
                heapq.heappush(agenda, (rank[found], at, middle, found))

        while agenda:
            _, at, middle, found = heapq.heappop(agenda)
            # the pieces may have been taken by other merges meanwhile
            if ids[at] < 0 or after[at] != middle or self.merges.get(ids[at] * self.n + ids[middle]) != found:
                continue
            ids[at], ids[middle] = found, -2
            after[at] = nxt = after[middle]
            if nxt < n:
                before[nxt] = at
                offer(at, nxt)
            if before[at] >= 0:
                offer(before[at], at)
        return [i for i in ids if i >= 0]

    def _skipped(self, keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(keys + salts) < self.limit

    def encode(self, texts: pa.Array, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of the texts; ``documents`` are keys (of document and copy) for the draws."""
        if len(self.ids) + len(self.salts) > self.memory:
            self._forget()
        full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        words = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy().astype(np.int64)
        place = np.arange(len(code)) - np.repeat(offsets[:-1], np.diff(offsets))
        with np.errstate(over="ignore"):
            key = mix64(np.repeat(mix64(documents + np.uint64(self.seed)), np.diff(offsets)) + place.astype(np.uint64))
        # a character has at most four bytes, so these may have more symbols than LONG
        long = np.array([4 * len(w) > LONG and len(self.characters([" " + w])[0]) > LONG for w in words], bool)
        root = np.full(len(words), self._runs([""])[0])  # long words take nothing from it
        short = np.flatnonzero(~long)
        root[short] = self._runs([words[i] for i in short])
        run = root[code]
        drawn = [np.zeros(0, np.int64)]
        for start in range(0, len(run) if self.limit else 0, PLACES):
            own = slice(start, start + PLACES)
            run[own], more = self._drawn(run[own], key[own])
            drawn.append(start + more)
        begin, size = self.begin[run], self.size[run]
        # places that no run is kept for
        drawn, apart = np.concatenate(drawn), np.flatnonzero(long[code])
        ids, ends, *_ = self.segment([" " + words[i] for i in code[drawn]], np.zeros(len(drawn), np.uint64), key[drawn])
        begin[drawn], size[drawn] = len(self.ids) + ends[:-1], np.diff(ends)
        extra = [np.array(self.segment_long(" " + words[code[i]], int(key[i])), np.int32) for i in apart]
        size[apart] = [len(x) for x in extra]
        begin[apart] = len(self.ids) + len(ids) + np.cumsum(size[apart]) - size[apart]
        ids = np.concatenate([self.ids, ids, *extra])
        # a text begins with the space that the model puts before it; an empty text has nothing
        size = np.where(np.repeat(full, np.diff(offsets)), size, 0)
        ends = np.concatenate(([0], np.cumsum(size)))
        flat = ids[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        return flat, ends[offsets]

    def _drawn(self, run: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs that places end in, from those without skips; and the places that skip more than one candidate."""
        run, todo = run.copy(), np.arange(len(run))
        for kept in (True, False):
            steps = self.steps[run[todo]]
            ends = np.cumsum(steps)
            who = np.repeat(np.arange(len(todo)), steps)
            step = np.arange(len(who)) - np.repeat(ends - steps, steps)
            hit = np.flatnonzero(self._skipped(key[todo][who], self.salts[np.repeat(self.first[run[todo]], steps) + step]))
            # the first draw of each place
            hit = hit[np.concatenate(([True], who[hit][1:] != who[hit][:-1]))[: len(hit)]]
            todo = todo[who[hit]]
            if kept:
                run[todo] = self._children(run[todo], step[hit])
        return run, todo

    def _runs(self, words: list[str]) -> np.ndarray:
        """The runs without skips."""
        new = [w for w in words if w not in self.roots]
        at = self._add(new, np.zeros(len(new), np.uint64))
        self.roots.update(zip(new, range(at, at + len(new)), strict=True))
        return np.array([self.roots[w] for w in words], np.int64)

    def _children(self, run: np.ndarray, step: np.ndarray) -> np.ndarray:
        """The runs that skip one of the merges of those without skips."""
        pairs, number = np.unique(run * LONG + step, return_inverse=True)  # a word has fewer merges than symbols
        names = pairs.tolist()
        new = [x for x in names if x not in self.children]
        run, step = np.divmod(np.array(new, np.int64), LONG)
        at = self._add([self.word[r] for r in run.tolist()], self.salts[self.first[run] + step])
        self.children.update(zip(new, range(at, at + len(new)), strict=True))
        return np.array([self.children[x] for x in names], np.int64)[number]

    def _add(self, words: list[str], skip: np.ndarray) -> int:
        """Make runs; the first one's number."""
        at = len(self.word)
        if words:
            ids, offsets, salts, first, steps = self.segment([" " + w for w in words], skip)
            self.begin, self.size = np.concatenate((self.begin, len(self.ids) + offsets[:-1])), np.concatenate((self.size, np.diff(offsets)))
            self.first, self.steps = np.concatenate((self.first, len(self.salts) + first)), np.concatenate((self.steps, steps))
            self.ids, self.salts = np.concatenate((self.ids, ids)), np.concatenate((self.salts, salts))
            self.word += words
        return at

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The texts that lists of ids spell, without the space before each."""
        size = self.spelt_size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        data = self.spelt[np.repeat(self.spelt_at[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        at = ends[offsets]
        return [data[a + 1 : b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _kept(path: str, seed: int, dropout: float) -> PieceModel:
    """The model, which a Python worker keeps from one task to its next ones."""
    kept = sys.modules.setdefault("seqframe_kept", types.ModuleType("seqframe_kept")).__dict__
    name = f"pieces {path} {seed} {dropout}"
    if name not in kept:
        kept[name] = PieceModel(path, seed, dropout)
    return kept[name]


def _encoded(path: str, seed: int, dropout: float, text: str, key: str, own: list[str], names: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _kept(path, seed, dropout)
        ids_name, crc_name, lossless_name = names
        for batch in batches:
            for part in slices(batch, text):
                texts = pc.fill_null(part.column(text), "")
                flat, offsets = model.encode(texts, part.column(key).to_numpy().view(np.uint64))
                decoded = model.decode(flat, offsets)
                lossless = [a == b for a, b in zip(decoded, texts.cast(pa.binary()).to_pylist(), strict=True)]
                data = flat.astype("<u4")
                crc = [zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield from_columns(**{c: part.column(c) for c in own}, **{
                    ids_name: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())), crc_name: pa.array(crc, pa.int64()), lossless_name: pa.array(lossless, pa.bool_())})

    return run


def numbered_copies(docs: DataFrame, copy: str = "copy") -> DataFrame:
    """``docs`` with a number (from 0) that tells equal rows apart: they are counted, before the shuffle too, and dealt out again."""
    (many,) = fresh(docs, "piece_copies")
    own = [F.col(f"`{c}`") for c in docs.columns]
    counted = docs.groupBy(*own).agg(F.count(F.lit(1)).alias(many))
    return counted.select(*own, F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1)).alias(copy))


def encode_pieces(docs: DataFrame, model_path: str, seed: int = 1, dropout: float = 0.1, doc_id: str = "doc_id", text: str = "text", copy: str | None = None,
                  ids: str = "ids", crc: str = "ids_crc32", lossless: str = "lossless", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the ids of the whole text, their crc32 as little-endian 32-bit numbers, and whether they
    decode to the text.  ``copy`` names a column that tells copies of a document apart, which are then cut by draws of their own."""
    own = docs.columns if keep is None else keep
    plain, key = fresh(docs, "piece_text", "piece_key")
    names = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")), *([F.col(copy).cast("long")] if copy else [])]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.coalesce(F.col(text), F.lit("")).alias(plain), F.xxhash64(*names, F.lit(seed)).alias(key))
    schema = schema_with(docs, own, **{ids: "array<int>", crc: "bigint", lossless: "boolean"})
    return rows.mapInArrow(tidy(_encoded(model_path, seed, dropout, plain, key, own, (ids, crc, lossless))), schema)


def decode_pieces(rows: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text that their ids spell."""
    own = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _kept(model_path, 0, 0.0)
        for batch in batches:
            lists = pc.fill_null(batch.column(ids), pa.scalar([], pa.list_(pa.int32())))
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy()[offsets[0] : offsets[-1]]
            spelt = [x.decode("utf-8", "replace") for x in model.decode(flat, offsets - offsets[0])]
            yield from_columns(**{c: batch.column(c) for c in own}, **{text: pa.array(spelt, pa.string())})

    return rows.mapInArrow(run, schema_with(rows, rows.columns, **{text: "string"}))
