"""Operator 8: byte-pair encoding and decoding.

The text is cut by the vocabulary's own pattern.  For each distinct piece a
dynamic programme over its prefixes stores the one token with which the encoding
of that prefix ends: the candidates are the tokens that are suffixes of the
prefix (one run of an Aho-Corasick automaton over the vocabulary, which stands
for the suffix automaton, gives them all, longest first), and a candidate
holds exactly when it can stand beside the stored last token of what is left of
it.  Following the stored tokens back from the end gives the exact ids.  Time is
linear in the piece, so a piece of any length is encoded whole.

Work is row-local in Arrow batches.  The distinct pieces of some MB of texts take
each step of the programme together in numpy, long ones go by themselves; a worker
keeps the tokens of the pieces it has met in a table of bounded size.

Defined results.  Null text encodes as the empty text: no ids.  Strings of
special tokens in a text become their ids, as the library does by default.
Repeated rows give equal rows; extra columns are left alone by ``encode``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from plebis.llm.common import table

#: The pattern by which byte-level vocabularies of this kind cut a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces, and pairs of tokens, that a worker keeps.
KEPT = 250_000
#: Bytes of the longest piece that is encoded side by side with others.
SIDE_BY_SIDE = 64
#: Bytes of texts that are encoded together.
SLICE = 2_000_000
#: White space as any of the engines here sees it, beside which a blank may not part pieces.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Vocabulary:
    """Tokens are numbered in the order in which merges make them, bytes first."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_byte = {c: b for b, c in letters.items()}
        ids = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = {letters[b]: b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(-1, -1)] * 256
        self.made: dict[tuple[int, int], int] = {}
        self.ids = [ids[letters[b]] for b in range(256)]
        names = [letters[b] for b in range(256)]
        for left, right in pairs:
            pair = (order[left], order[right])
            self.made[pair] = len(names)
            self.halves.append(pair)
            order.setdefault(left + right, len(names))
            self.ids.append(ids[left + right])
            names.append(left + right)
        self.suffixes = ahocorasick.Automaton()
        self.content: dict[int, bytes] = {}
        for n, name in enumerate(names):
            raw = bytes(as_byte[c] for c in name)
            self.content[self.ids[n]] = raw
            self.suffixes.add_word(raw.decode("latin-1"), (n, len(raw)))
        self.suffixes.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.content |= {i: s.encode() for s, i in self.special.items()}
        self.pieces = regex.compile(PIECES)
        self.specials = (
            regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
            if self.special
            else None
        )
        self.beside: dict[int, bool] = {}
        self._automaton([bytes(as_byte[c] for c in name) for name in names])
        self.known = Pieces.empty()
        self.pair_codes, self.pair_good = np.zeros(0, np.int64), np.zeros(0, bool)
        strings = [str(i) for i in self.ids] + [str(i) for i in self.special.values()]
        self.written = pa.array(strings, pa.string())
        self.bytes_of = pa.array([self.content[int(i)] for i in strings], pa.binary())
        self.number = {s: len(self.ids) + n for n, s in enumerate(self.special)}

    def _automaton(self, tokens: list[bytes]) -> None:
        """Arrays of the suffix-matching automaton, so that many pieces step at once:
        for each state the longest token that is a suffix, for each token the next
        shorter one."""
        children: dict[int, int] = {}
        token_at, depth_first, byte_of, parent = [-1], [0], [0], [0]
        ends = []
        for n, raw in enumerate(tokens):
            node = 0
            for byte in raw:
                code = node << 8 | byte
                child = children.get(code)
                if child is None:
                    child = children[code] = len(token_at)
                    token_at.append(-1)
                    parent.append(node)
                    byte_of.append(byte)
                    depth_first.append(depth_first[node] + 1)
                node = child
            if token_at[node] < 0:
                token_at[node] = n
            ends.append(node)
        fail, longest = [0] * len(token_at), list(token_at)
        for node in sorted(range(1, len(token_at)), key=depth_first.__getitem__):
            if parent[node]:
                back = fail[parent[node]]
                while back and back << 8 | byte_of[node] not in children:
                    back = fail[back]
                fail[node] = children.get(back << 8 | byte_of[node], 0)
            if longest[node] < 0:
                longest[node] = longest[fail[node]]
        codes = np.array(sorted(children), np.int64)
        self.codes, self.targets = codes, np.array([children[c] for c in codes.tolist()], np.int64)
        self.fail, self.longest = np.array(fail), np.array(longest)
        self.shorter = np.array([longest[fail[node]] for node in ends])
        self.length = np.array([len(t) for t in tokens])
        made = sorted((a << 20 | b, n) for (a, b), n in self.made.items())
        self.made_codes, self.made_as = np.array([c for c, _ in made], np.int64), np.array([n for _, n in made], np.int64)
        self.half = np.array(self.halves, np.int64)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes together is just these two.

        Walks back in time over the tokens that touch the border, undoing the
        younger first; they are incompatible if at some time the two that touch
        would have been merged before either went into a larger token.
        """
        a, b, before = left, right, 1 << 62
        while True:
            m = self.made.get((a, b))
            if m is not None and m < before:
                good = False
                break
            if max(a, b) < 256:
                good = True
                break
            if a > b:
                before, a = a, self.halves[a][1]
            else:
                before, b = b + 1, self.halves[b][0]
        if len(self.beside) >= KEPT // 4:
            self.beside.clear()
        self.beside[left << 20 | right] = good
        return good

    def compatible_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The same of many pairs, each distinct one walked once."""
        codes = left.astype(np.int64) << 20 | right
        place, hit = _find(self.pair_codes, codes)
        good = np.zeros(len(codes), bool)
        good[hit] = self.pair_good[place[hit]]
        if not hit.all():
            new, inverse = np.unique(codes[~hit], return_inverse=True)
            walked = self._walk(new >> 20, new & ((1 << 20) - 1))
            good[~hit] = walked[inverse]
            if len(self.pair_codes) + len(new) > KEPT:
                self.pair_codes, self.pair_good = new, walked
            else:
                where = np.searchsorted(self.pair_codes, new)
                self.pair_codes, self.pair_good = np.insert(self.pair_codes, where, new), np.insert(self.pair_good, where, walked)
        return good

    def _walk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b, before = a.copy(), b.copy(), np.full(len(a), 1 << 62)
        good, at = np.zeros(len(a), bool), np.arange(len(a))
        while len(at):
            place, hit = _find(self.made_codes, a << 20 | b)
            merged = np.zeros(len(at), bool)
            merged[hit] = self.made_as[place[hit]] < before[hit]
            done = ~merged & (np.maximum(a, b) < 256)
            good[at[done]] = True
            go = ~merged & ~done
            at, a, b = at[go], a[go], b[go]
            back = a > b
            before = np.where(back, a, b + 1)
            a, b = np.where(back, self.half[a, 1], a), np.where(back, b, self.half[b, 0])
        return good

    def encode_piece(self, piece: str) -> list[int]:
        """Token numbers of one piece, of whatever length."""
        raw = piece.encode().decode("latin-1")
        last, length = [-1] * len(raw), [0] * len(raw)
        beside, compatible = self.beside, self.compatible
        for end, (token, size) in self.suffixes.iter(raw):
            if last[end] < 0:
                start = end - size
                if start >= 0:
                    good = beside.get(last[start] << 20 | token)
                    if good is None:
                        good = compatible(last[start], token)
                    if not good:
                        continue
                last[end], length[end] = token, size
        tokens, at = [], len(raw) - 1
        while at >= 0:
            tokens.append(last[at])
            at -= length[at]
        return tokens[::-1]

    def encode_side_by_side(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of short pieces, one after another, and each one's count.
        Every step of the programme is taken for all pieces together."""
        sizes = pc.binary_length(pieces).to_numpy()
        by_size = np.argsort(-sizes, kind="stable")
        n = sizes[by_size].astype(np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pieces.take(pa.array(by_size))), "")
        letters = np.zeros((len(n), int(n[0])), np.uint8)
        letters[np.arange(n[0])[None, :] < n[:, None]] = np.frombuffer(joined[0].as_buffer(), np.uint8)
        last = np.full(letters.shape, -1, np.int64)
        state = np.zeros(len(n), np.int64)
        for end in range(int(n[0])):
            live = int(np.searchsorted(-n, -end))  # pieces longer than ``end``
            state = self._step(state[:live], letters[:live, end])
            token, open_ = self.longest[state], np.arange(live)
            while len(open_):
                own = token[open_]
                start = end - self.length[own]
                good = start < 0
                inner = np.flatnonzero(~good)
                good[inner] = self.compatible_pairs(last[open_[inner], start[inner]], own[inner])
                last[open_[good], end] = own[good]
                open_ = open_[~good]
                token[open_] = self.shorter[token[open_]]
        at, live, rounds = n - 1, np.arange(len(n)), []
        while len(live):
            own = last[live, at[live]]
            rounds.append((live, own))
            at[live] -= self.length[own]
            live = live[at[live] >= 0]
        counts = np.zeros(len(n), np.int64)
        for live, _ in rounds:
            counts[live] += 1
        placed = np.zeros(len(n), np.int64)
        placed[by_size] = counts
        ends = np.cumsum(placed)[by_size]
        tokens = np.zeros(int(placed.sum()), np.int32)
        for k, (live, own) in enumerate(rounds):
            tokens[ends[live] - 1 - k] = own
        return tokens, placed

    def _step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        new, open_ = np.zeros(len(state), np.int64), np.arange(len(state))
        while len(open_):
            place, hit = _find(self.codes, state[open_] << 8 | letter[open_].astype(np.int64))
            new[open_[hit]] = self.targets[place[hit]]
            open_ = open_[~hit]
            open_ = open_[state[open_] > 0]
            state = state.copy()
            state[open_] = self.fail[state[open_]]
        return new

    def tokens_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of distinct pieces, one after another, and their bounds."""
        place = pc.index_in(pieces, value_set=self.known.pieces)
        if place.null_count:
            missing = pieces.filter(place.is_null())
            long = pc.greater(pc.binary_length(missing), SIDE_BY_SIDE)
            for s in self.special:
                long = pc.or_(long, pc.equal(missing, s))
            short, others = missing.filter(pc.invert(long)), _strings(missing.filter(long))
            tokens, counts = self.encode_side_by_side(short) if len(short) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            found = [[self.number[p]] if p in self.number else self.encode_piece(p) for p in others]
            tokens = np.concatenate([tokens, *(np.array(f, np.int32) for f in found)])
            counts = np.concatenate([counts, np.array([len(f) for f in found], np.int64)])
            if len(self.known.pieces) + len(missing) > KEPT:  # only what is met now stays
                self.known = self.known.those(place.drop_null())
            self.known = self.known.more(pa.concat_arrays([short, pa.array(others, pa.string())]), tokens, counts)
            place = pc.index_in(pieces, value_set=self.known.pieces)
        return gather(self.known.tokens, self.known.bounds, place.to_numpy().astype(np.int64))

    def split(self, text: str) -> list[str]:
        """All pieces of a whole text."""
        found: list[str] = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                found.append(part)
            elif part:
                found += self.pieces.findall(part)
        return found

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each text's ids, joined by commas, and the bytes they decode to.

        A blank between two characters that are not white space always starts a
        piece, so the runs between blanks are cut one by one, each distinct one
        once, and their tokens gathered.  Texts with a blank beside white space, or
        with the string of a special token, are cut whole.
        """
        lists = pc.split_pattern(texts, " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        coded = lists.flatten().dictionary_encode()
        runs, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        matches = lambda pattern: pc.match_substring_regex(runs, pattern).to_numpy(zero_copy_only=False)
        left, right = ~matches(f"^{WHITE}|^$")[at], ~matches(f"{WHITE}$|^$")[at]
        n, begins, last = np.diff(ends), ends[:-1], ends[1:] - 1
        left[begins], right[last] = True, True
        bad = ~(left & right)
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            if " " in s:
                whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
            else:
                bad |= pc.match_substring(runs, s).to_numpy(zero_copy_only=False)[at]
        whole |= np.add.reduceat(bad, begins) > 0

        # Units: runs within texts, then first runs, last runs and whole texts.
        parted = ~whole
        middle = np.repeat(parted, n)
        middle[begins], middle[last] = False, False
        used, unit_at = np.unique(at[middle], return_inverse=True)
        pieces = self.pieces.findall(" " + " ".join(_strings(runs.take(pa.array(used))))) if len(used) else []
        starts = np.flatnonzero(pc.starts_with(pa.array(pieces, pa.string()), " ").to_numpy(zero_copy_only=False)) if pieces else np.zeros(0, np.int64)
        cut = list(map(self.pieces.findall, _strings(runs.take(pa.array(at[begins[parted]])))))
        ended = parted & (n > 1)
        cut += [self.pieces.findall(" " + r) for r in _strings(runs.take(pa.array(at[last[ended]])))]
        cut += [self.split(t) for t in texts.filter(pa.array(whole)).to_pylist()]
        sizes = np.concatenate([np.diff(np.append(starts, len(pieces))), np.array([len(c) for c in cut], np.int64)])
        for c in cut:
            pieces += c
        units = np.full(len(at), -1)
        units[middle] = unit_at
        base = len(used)
        for which, where in ((parted, begins), (ended, last), (whole, begins)):
            units[where[which]] = base + np.arange(int(which.sum()))
            base += int(which.sum())
        distinct = pa.array(pieces, pa.string()).dictionary_encode()
        tokens, bounds = self.tokens_of(distinct.dictionary)
        bounds_of = lambda sizes_: np.concatenate([[0], np.cumsum(sizes_)]).astype(np.int64)
        by_piece = bounds_of(sizes)
        tokens, bounds = gather(tokens, bounds, distinct.indices.to_numpy().astype(np.int64))
        bounds = bounds[by_piece]  # of units
        tokens, bounds = gather(tokens, bounds, units[units >= 0])
        where = pa.array(tokens)
        offsets = pa.array(bounds[bounds_of(np.where(whole, 1, n))].astype(np.int32))
        ids = pc.binary_join(pa.ListArray.from_arrays(offsets, self.written.take(where)), ",")
        return ids, pc.binary_join(pa.ListArray.from_arrays(offsets, self.bytes_of.take(where)), b"")


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted array, and which of them are there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return place, known[place] == wanted


def gather(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered ``which`` of those that lie between bounds in ``values``."""
    sizes = (bounds[1:] - bounds[:-1])[which]
    ends = np.cumsum(sizes)
    new = np.concatenate([[0], ends]).astype(np.int64)
    return values[np.repeat(bounds[which] - new[:-1], sizes) + np.arange(int(new[-1]))], new


class Pieces:
    """Pieces and their tokens."""

    def __init__(self, pieces: pa.Array, tokens: np.ndarray, bounds: np.ndarray):
        self.pieces, self.tokens, self.bounds = pieces, tokens, bounds

    @classmethod
    def empty(cls) -> Pieces:
        return cls(pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64))

    def those(self, which: pa.Array) -> Pieces:
        return Pieces(self.pieces.take(which), *gather(self.tokens, self.bounds, which.to_numpy()))

    def more(self, pieces: pa.Array, tokens: np.ndarray, counts: np.ndarray) -> Pieces:
        bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])
        return Pieces(pa.concat_arrays([self.pieces, pieces]), np.concatenate([self.tokens, tokens]), bounds)


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """Texts in order, some MB at a time; a longer one by itself."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1)
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield texts.slice(start, end - start)
        start = end


def _encoded(docs: DataFrame, text: str, path: str, kept: list[str], fields: list[tuple[str, pa.DataType, str]], make) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    schema = ", ".join(filter(None, [schema, *(f"{n} {s}" for n, _, s in fields)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.num_columns - 1), "")
            rows = []
            for part in slices(texts):
                ids, raw = words.encode(part)
                rows += map(make, ids.to_pylist(), raw.to_pylist())
            pa.default_memory_pool().release_unused()
            made = [pa.array([r[n] for r in rows], type=kind) for n, (_, kind, _) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], *made], names=[*kept, *(n for n, _, _ in fields)]
            )

    return docs.select(*[docs[c] for c in kept], docs[text].alias("__text")).mapInArrow(run, schema)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Rows (key, ids, decoded): the ids of every whole text and their decoding."""
    return _encoded(
        docs,
        text,
        path or default_path(),
        [key],
        [("ids", pa.list_(pa.int32()), "array<int>"), ("decoded", pa.string(), "string")],
        lambda ids, raw: ([int(i) for i in ids.split(",")] if ids else [], raw.decode("utf-8", "replace")),
    )


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Rows (key, n_tokens, ids_sha256, decoded_sha256), made where the ids are,
    so that neither ids nor decoded texts leave the worker."""
    return _encoded(
        docs,
        text,
        path or default_path(),
        [key],
        [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")],
        lambda ids, raw: (
            ids.count(",") + 1 if ids else 0,
            hashlib.sha256(ids.encode()).hexdigest(),
            hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest(),
        ),
    )


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
