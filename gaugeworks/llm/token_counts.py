"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer (a `tokenizers` file) becomes a deterministic transducer over characters. Each transition is annotated with the change in the number of tokens that reading its character makes, so the sum along a path is the count of the text so far, and a final value per state adds what is still pending at the end.

Two layers make up a state. The outer one is the split into pre-tokens: which kind of run is open, whether white space is held back, whether an apostrophe may begin a contraction. The inner one is BPE within the open pre-token. It rests on this: where the tokens of a text have a boundary, no merge has crossed it, so the tokens on each side are those of that side alone. The last token of each prefix hence follows from the last tokens of the prefixes before it: t ends the prefix x t if BPE keeps (last token of x, t) apart. All that later characters can ask about is the last token in front of each suffix of the text that may still grow into a token; that is the state, and there are finitely many. States are made when first reached and remembered.

A text's chunk is a map from the state before it to a count and the state after it. Two neighbouring characters of different classes fix the state whatever came before, so a chunk's map is: apply the states to its head, up to such a place, then add a constant and go to a constant state. Such maps compose (associatively), which Spark does in two levels: runs of chunks, then runs of runs."""

from __future__ import annotations

import json
import re
import struct
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, M64, fresh, slices, table, with_fields

#: Texts of more bytes are cut into chunks of about so many, which are counted apart.
CHUNK = 1 << 16
#: Chunks that one task composes into a longer one at a time.
FAN_IN = 64
#: Characters between places where texts are cut into stretches that are run side by side; with fewer left than FEW, one after the other.
LANE, FEW = 256, 16
#: Transitions that a Python worker remembers (about 250 bytes each with their states); beyond, it starts afresh between batches.
REMEMBERED = 1_000_000

#: What follows an apostrophe in a contraction at the start of a pre-token: fixed values of the byte-level pre-tokenizer.
ONE_LETTER, TWO_LETTERS = "stmd", {"r": "e", "v": "e", "l": "l"}

# Classes of characters; a state's kind is that of the run that is open, or one of those after.
LETTERS, NUMBERS, OTHERS, SPACE, START, APOSTROPHE, BEGUN, WHITE, UNKNOWN = range(9)
NEVER, ZERO = 1 << 40, 1 << 19


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level files write bytes: visible Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}


class Vocabulary:
    """What the transducer needs of a byte-level BPE file: the trie of its tokens, merges by pair, and the added tokens' strings. Tokens are numbered as they come, single bytes first."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": pre.get("trim_offsets"), "use_regex": True} or model["type"] != "BPE":
            raise ValueError("only byte-level BPE without normalizer or prefix space is supported")
        if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("a BPE option that isn't supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that look at their surroundings aren't supported")
        self.added = sorted((t["content"] for t in spec["added_tokens"]), key=lambda t: (-len(t), t))
        byte_of = byte_letters()
        raw = lambda t: bytes(map(byte_of.__getitem__, t))
        self.number = {bytes((i,)): i for i in range(256)}
        self.ranks: dict[int, int] = {}  # by both numbers
        self.made_of: dict[int, tuple[int, int, int]] = {}  # rank and parts of the merge that makes a token
        #: Whether each token has one merge, later than those of its parts. Then merges happen in the order of ranks, and apart() can follow the edges of two tokens.
        self.proper = True
        for rank, m in enumerate(model["merges"]):
            x, y = map(raw, m if isinstance(m, list) else m.split(" "))
            a, b = self.number[x], self.number[y]
            t = self.number.setdefault(x + y, len(self.number))
            self.proper &= t not in self.made_of and all(q < 256 or q in self.made_of for q in (a, b))
            self.made_of.setdefault(t, (rank, a, b))
            self.ranks.setdefault(a << 20 | b, rank)
        self.bytes_of = list(self.number)
        self.edges: tuple[dict, dict] = ({}, {})
        self._grow_trie()

    def _grow_trie(self) -> None:
        """`child` by node << 8 | byte; per node the token it stands for, -1 if BPE doesn't make it of its own bytes, and whether longer tokens begin with it."""
        self.child: dict[int, int] = {}
        self.token_at, self.grows = [-1], [True]
        for t, data in enumerate(self.bytes_of):
            node = 0
            for b in data:
                self.grows[node] = True
                k = node << 8 | b
                if k not in self.child:
                    self.child[k] = len(self.token_at)
                    self.token_at.append(-1)
                    self.grows.append(False)
                node = self.child[k]
            if self.proper or len(self.bpe(data)) == 1:
                self.token_at[node] = t
        if self.proper:  # then a token whose own parts don't stay apart is made of its bytes
            for t, (_, a, b) in self.made_of.items():
                if len(self.bpe(self.bytes_of[t])) != 1:
                    node = 0
                    for x in self.bytes_of[t]:
                        node = self.child[node << 8 | x]
                    self.token_at[node] = -1

    def bpe(self, data: bytes) -> list[int]:
        """Tokens of a pre-token: the neighbours of the earliest merge are joined first, of equal ones the leftmost."""
        part: list[int] = [*data]
        n, ranks, number, names = len(part), self.ranks.get, self.number, self.bytes_of
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := ranks(part[i] << 20 | part[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if part[i] < 0 or j >= n or ranks(part[i] << 20 | part[j]) != r:
                continue
            part[i], part[j] = number[names[part[i]] + names[part[j]]], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks(part[i] << 20 | part[k])) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks(part[h] << 20 | part[i])) is not None:
                heappush(heap, (r, h))
        return [p for p in part if p >= 0]

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The parts that lie at a token's right (or left) edge while it is made, first to last, each with the rank of the merge that ends it."""
        out = self.edges[right].get(token)
        if out is None:
            if token < 256:
                out = [(token, NEVER)]
            else:
                rank, a, b = self.made_of[token]
                inner = self.edge(b if right else a, right)
                out = [*inner[:-1], (inner[-1][0], rank), (token, NEVER)]
            self.edges[right][token] = out
        return out

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE of two tokens' bytes together gives these two tokens: no merge across them comes before those inside them. Of equal merges, the leftmost comes first."""
        if not self.proper:
            return self.bpe(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        mine, theirs, ranks, i, j = self.edge(left, True), self.edge(right, False), self.ranks.get, 0, 0
        while True:
            (a, ra), (b, rb) = mine[i], theirs[j]
            r = ranks(a << 20 | b)
            if r is not None and r < ra and r <= rb:
                return False
            if ra == rb == NEVER:
                return True
            if ra <= rb:
                i += 1
            else:
                j += 1


class Edges:
    """The transitions found so far: a hash table of arrays, so that many can be looked up at once. Values aren't negative."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.size = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        at = self._places(keys)
        have = self.keys[at]
        out = np.where(have == keys, self.values[at], -1)
        open_ = np.flatnonzero((have != keys) & (have >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            have = self.keys[at[open_]]
            hit = have == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (have >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys, all different, that aren't there."""
        if (self.size + len(keys)) * 2 > 1 << self.bits:
            old, kept = self.keys[self.keys >= 0], self.values[self.keys >= 0]
            self.__init__(max(self.bits + 1, (4 * (len(old) + len(keys))).bit_length()))
            self.put(old, kept)
        at, left, mask = self._places(keys), np.arange(len(keys)), (1 << self.bits) - 1
        self.size += len(keys)
        while len(left):  # each writes itself into its place where that is free; who stays there has it
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & mask
        self.values[at] = values


class Transducer:
    """The compiled tokenizer. A state's number stands for its key: the kind, the character held back, and the fronts. A front is a suffix of the open pre-token that may grow into a token (a node of the trie), the last token in front of it, and how many tokens fewer the text has there; the longest comes first, the empty one last."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.added = re.compile("|".join(map(re.escape, vocabulary.added))) if vocabulary.added else None
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.empty = [_front(0, -1, 0)]
        self.forget()

    def forget(self) -> None:
        """Drops all states; their keys stay valid."""
        self.edges = Edges()
        self.near: dict[int, int] = {}
        self.number: dict[bytes, int] = {}
        self.keys: list[bytes] = []
        self.endings: dict[int, int] = {}
        self.start = self.state(START, self.empty)

    def tidy(self) -> None:
        if self.edges.size > REMEMBERED:
            self.forget()
        elif len(self.near) > REMEMBERED // 4:
            self.near = {}

    # --- the inner layer ------------------------------------------------------------------------

    def read(self, fronts: list[int], byte: int) -> tuple[list[int], int]:
        """The fronts after one byte more, and the change in the number of tokens."""
        v = self.vocabulary
        child, token_at, grows, ends, out, more = v.child.get, v.token_at, v.grows, -1, [], 0
        for f in fronts:
            node = child(f >> 40 << 8 | byte)
            if node is None:
                continue
            if ends < 0 and (t := token_at[node]) >= 0 and ((last := (f >> 20 & 0xFFFFF) - 1) < 0 or v.apart(last, t)):
                ends, more = t, 1 - ((f & 0xFFFFF) - ZERO)
            if grows[node]:
                out.append(node << 40 | f & 0xFFFFFFFFFF)
        return [f + more for f in out] + [_front(0, ends, 0)], more

    def through(self, fronts: list[int], char: str) -> tuple[list[int], int]:
        total = 0
        for b in char.encode():
            fronts, more = self.read(fronts, b)
            total += more
        return fronts, total

    # --- the outer layer ------------------------------------------------------------------------

    def state(self, kind: int, fronts: list[int], pending: str = "") -> int:
        key = struct.pack("<BI", kind, ord(pending) if pending else 0) + array("q", fronts).tobytes()
        return self.numbered(key)

    def numbered(self, key: bytes) -> int:
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.keys)
            self.keys.append(key)
        return n

    def parts(self, state: int) -> tuple[int, list[int], str]:
        key = self.keys[state]
        kind, pending = struct.unpack_from("<BI", key)
        return kind, [*array("q", key[5:])], chr(pending) if pending or kind == WHITE else ""

    def ending(self, state: int) -> int:
        """Tokens more if the text ends here."""
        out = self.endings.get(state)
        if out is None:
            kind, fronts, pending = self.parts(state)
            out = self.endings[state] = self.through(fronts, pending)[1] if kind == WHITE else 0
        return out

    def class_of(self, char: str) -> int:
        kind = int(self.classes[ord(char)])
        if kind == UNKNOWN:
            kind = self.classes[ord(char)] = _class_of(char)
        return kind

    def opened(self, char: str) -> tuple[int, int]:
        """What follows when char is the first of a pre-token."""
        kind = self.class_of(char)
        if kind == SPACE:
            return self.state(WHITE, self.empty, char), 0
        fronts, more = self.through(self.empty, char)
        return self.state(APOSTROPHE if char == "'" else kind, fronts), more

    def step(self, state: int, char: str) -> tuple[int, int]:
        """The transition by char: the state after it and the tokens more."""
        kind, fronts, pending = self.parts(state)
        c = self.class_of(char)
        if kind == BEGUN:  # an apostrophe and a letter that may begin a contraction, counted as two pre-tokens so far
            if char == TWO_LETTERS[pending]:
                return self.start, len(self.vocabulary.bpe(f"'{pending}{char}".encode())) - 2
            kind = LETTERS
        if kind == APOSTROPHE:
            if char in ONE_LETTER:
                return self.start, self.through(fronts, char)[1]
            if char in TWO_LETTERS:
                fronts, more = self.through(self.empty, char)
                return self.state(BEGUN, fronts, char), more
            kind = OTHERS
        if kind == WHITE:
            if c == SPACE:  # the white space held back belongs to the run
                fronts, more = self.through(fronts, pending)
                return self.state(WHITE, fronts, char), more
            if pending == " ":
                fronts, more = self.through(self.empty, " " + char)
                return self.state(c, fronts), more
            after, more = self.opened(char)
            return after, more + self.through(self.empty, pending)[1]
        if c == kind:
            fronts, more = self.through(fronts, char)
            return self.state(kind, fronts), more
        return self.opened(char)

    def made(self, keys: np.ndarray) -> np.ndarray:
        """Transitions that aren't there yet, of keys state << 21 | character; as state << 16 | tokens more + 2 ** 15."""
        out = []
        for key in keys.tolist():
            state, more = self.step(key >> 21, chr(key & 0x1FFFFF))
            out.append(state << 16 | more + 0x8000)
        values = np.array(out, np.int64)
        self.edges.put(keys, values)
        return values

    def edge(self, key: int) -> int:
        keys = np.array([key], np.int64)
        value = int(self.edges.find(keys)[0])
        return value if value >= 0 else int(self.made(keys)[0])

    # --- texts and chunks -----------------------------------------------------------------------

    def run(self, state: int, chars) -> tuple[int, int]:
        """One text, character by character."""
        n, near = 0, self.near
        for c in chars:
            k = state << 21 | c
            v = near.get(k)
            if v is None:
                v = near[k] = self.edge(k)
            state = v >> 16
            n += (v & 0xFFFF) - 0x8000
        return state, n

    def run_many(self, chars: np.ndarray, begin: np.ndarray, end: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last states, counts) of stretches of chars, all from the start, side by side. Where taken, the first character only leads to a state and isn't counted."""
        order = np.argsort(begin - end, kind="stable")
        at, length, skip = begin[order], (end - begin)[order], taken[order]
        states, counts = np.full(len(at), self.start, np.int64), np.zeros(len(at), np.int64)
        running = np.searchsorted(-length, -np.arange(int(length[0]) + 1 if len(length) else 1), side="left")
        for j, m in enumerate(running):
            if m < FEW:
                break
            keys = states[:m] << 21 | chars[at[:m] + j]
            values = self.edges.find(keys)
            if (new := np.flatnonzero(values < 0)).size:
                missing, which = np.unique(keys[new], return_inverse=True)
                values[new] = self.made(missing)[which]
            states[:m] = values >> 16
            more = (values & 0xFFFF) - 0x8000
            counts[:m] += np.where(skip[:m], 0, more) if j == 0 else more
        for i in range(int(running[j]) if len(length) else 0):  # a few long ones are left
            rest = chars[at[i] + j : at[i] + length[i]].tolist()
            state, n = self.run(int(states[i]), rest[: j == 0])
            counts[i] += 0 if j == 0 and skip[i] else n
            states[i], n = self.run(state, rest[j == 0 :])
            counts[i] += n
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return states[back], counts[back]

    def fixed(self, chars: np.ndarray) -> np.ndarray:
        """Places (from 1) whose character's class follows another one, after which the state doesn't depend on what came before. An apostrophe as the first of the two doesn't count: what it opens depends on that."""
        kinds = self.classes[chars]
        if (new := kinds == UNKNOWN).any():
            for c in np.unique(chars[new]).tolist():
                self.classes[c] = _class_of(chr(c))
            kinds = self.classes[chars]
        return np.flatnonzero((kinds[1:] != kinds[:-1]) & (chars[:-1] != 0x27)) + 1

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. All texts are cut into stretches at places that fix the state, about LANE characters apart, and these are run side by side."""
        segments = [self.added.split(t) if self.added else [t] for t in texts]
        total = np.array([len(s) - 1 for s in segments], np.int64)
        owner = np.repeat(np.arange(len(texts)), total + 1)
        chars = _code_points("".join(map("".join, segments)))
        stop = np.cumsum(np.fromiter((len(x) for s in segments for x in s), np.int64, len(owner)))
        start = np.concatenate(([0], stop[:-1]))[: len(stop)]
        full = start < stop
        start, stop, owner = start[full], stop[full], owner[full]
        if not len(start):
            return total.tolist()
        cuts = self.fixed(chars)
        first = np.zeros(len(chars), bool)
        first[start] = True
        cuts = cuts[~first[cuts] & ~first[cuts - 1]]
        wanted = np.flatnonzero(np.diff(cuts // LANE, prepend=-1))
        cuts = cuts[wanted]
        begin = np.concatenate((start, cuts))
        inside = np.concatenate((np.zeros(len(start), bool), np.ones(len(cuts), bool)))
        order = np.argsort(begin, kind="stable")
        begin, inside = begin[order], inside[order]
        end = np.append(begin[1:], len(chars))
        of = np.searchsorted(start, begin, side="right") - 1
        states, n = self.run_many(chars, begin - inside, end, inside)
        np.add.at(total, owner[of], n)
        last = np.append(np.flatnonzero(~inside)[1:] - 1, len(begin) - 1)
        np.add.at(total, owner, np.array([self.ending(s) for s in states[last].tolist()], np.int64))
        self.tidy()
        return total.tolist()

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def cuts(self, text: str, size: int) -> list[str]:
        """The text in chunks of so many characters, longer where a cut would part an added token."""
        out, at, n = [], 0, len(text)
        spans = ((m.start(), m.end()) for m in self.added.finditer(text)) if self.added else iter(())
        span = next(spans, None)
        while at < n:
            end = min(n, at + size)
            while span and span[1] <= end:
                span = next(spans, None)
            if span and span[0] < end:
                end = span[1]
            out.append(text[at:end])
            at = end
        return out

    def chunk(self, text: str) -> Map:
        """The chunk's map from the state before it to a count and the state after it."""
        first, *rest = self.added.split(text) if self.added else [text]
        chars = _code_points(first)
        places = self.fixed(chars)
        if len(places):
            k = int(places[0])
            state, _ = self.run(self.start, chars[k - 1 : k + 1].tolist())
            state, n = self.run(state, chars[k + 1 :].tolist())
            out = Map(first[: k + 1], 0, self.keys[state], n)
        else:
            out = Map(first)
        for part in rest:  # an added token sets the machine back
            state, n = self.run(self.start, map(ord, part))
            out = Map.composed(self, out, Map("", 1, self.keys[state], n, True))
        return out


def _front(node: int, last: int, fewer: int) -> int:
    return node << 40 | last + 1 << 20 | fewer + ZERO


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)


class Map:
    """A map of states: through `head` first. Then, if `after` is a state's key, `n` tokens more and the state `after`, whatever state the head led to; if it's None, the map ends there. `resets`: an added token (`extra` tokens) follows the head, so that what was pending there is due."""

    __slots__ = ("after", "extra", "head", "n", "resets")

    def __init__(self, head: str, extra: int = 0, after: bytes | None = None, n: int = 0, resets: bool = False) -> None:
        self.head, self.extra, self.after, self.n, self.resets = head, extra, after, n, resets

    def applied(self, machine: Transducer, state: int) -> tuple[int, int]:
        state, n = machine.run(state, map(ord, self.head))
        if self.after is None:
            return state, n
        return machine.numbered(self.after), n + self.n + self.extra + (machine.ending(state) if self.resets else 0)

    @staticmethod
    def composed(machine: Transducer, a: Map, b: Map) -> Map:
        """First a, then b."""
        if a.after is None:
            return Map(a.head + b.head, b.extra, b.after, b.n, b.resets)
        state, n = b.applied(machine, machine.numbered(a.after))
        return Map(a.head, a.extra, machine.keys[state], a.n + n, a.resets)

    def packed(self) -> bytes:
        import pickle

        return pickle.dumps((self.head, self.extra, self.after, self.n, self.resets), 5)

    @staticmethod
    def unpacked(data: bytes) -> Map:
        import pickle

        return Map(*pickle.loads(data))


def _class_of(char: str) -> int:
    """The class as the library's own version of Unicode has it: seen from whether it lets the character join a run."""
    split = _pre_tokenizer().pre_tokenize_str
    return next((kind for kind, run in ((LETTERS, "a"), (NUMBERS, "1"), (OTHERS, "!")) if len(split(run + char)) == 1), SPACE)


@cache
def _pre_tokenizer():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False)


def _transducer(broadcast, made: dict = {}) -> Transducer:  # noqa: B006 the dict is the worker's memory between tasks
    if made.get("of") != broadcast.value:
        made |= {"of": broadcast.value, "machine": Transducer(Vocabulary(broadcast.value))}
    return made["machine"]


def counts(docs: DataFrame, vocabulary: str, text_col: str = "text", limit: int = 512, chunk: int = CHUNK, keep_text: bool = True) -> DataFrame:
    """docs, without the text unless keep_text, with n_bytes, n_tokens and over_limit (n_tokens > limit), by these names plus underscores where docs has them.

    Null text counts as empty. Texts of up to `chunk` bytes are counted where they lie. Longer ones are cut; equal ones among them once; chunks are dealt to tasks, counted as maps, and the maps composed. Added tokens inside a text are one token each. The file is read on the driver and broadcast (1.5 MB for 50,000 tokens)."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    names = fresh(docs, "n_bytes", "n_tokens", "over_limit", "text_key", "place", "part")
    n_bytes, n_tokens, over, key, place, part = names
    docs = docs.withColumn(n_bytes, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"))
    dropped = [] if keep_text else [text_col]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(shared)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col))
            batch = batch.append_column(n_tokens, pa.array(machine.counts([x or "" for x in texts.to_pylist()]), pa.int64()))
            yield batch.drop_columns(dropped)

    schema = with_fields(docs.drop(*dropped), (n_tokens, "long"))
    whole = docs.where(F.col(n_bytes) <= chunk).mapInArrow(short, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(shared)
        for batch in slices(batches, 1):
            pieces = machine.cuts(batch.column(1)[0].as_py(), chunk)
            for i in range(0, len(pieces), 64):
                some = pieces[i : i + 64]
                yield pa.record_batch([pa.array([batch.column(0)[0].as_py()] * len(some)), pa.array(range(i, i + len(some)), pa.int64()), pa.array(some, pa.string())], names=[key, place, part])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(shared)
        for batch in slices(batches, 64):
            maps = [machine.chunk(x.as_py()).packed() for x in batch.column(2)]
            machine.tidy()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=[key, place, part])

    def composed(rows: pa.Table) -> pa.Table:
        """One map of a run of neighbouring chunks."""
        machine, rows, out = _transducer(shared), rows.sort_by(place), Map("")
        for x in rows.column(part):
            out = Map.composed(machine, out, Map.unpacked(x.as_py()))
        return pa.table({key: rows.column(key)[:1], place: [rows.column(place)[0].as_py() // FAN_IN], part: pa.array([out.packed()], pa.binary())})

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(shared)
        for batch in slices(batches):
            totals = []
            for x in batch.column(2):
                state, n = Map.unpacked(x.as_py()).applied(machine, machine.start)
                totals.append(n + machine.ending(state))
            yield pa.record_batch([batch.column(0), pa.array(totals, pa.int64())], names=[key, n_tokens])

    kinds = f"`{key}` string, `{place}` long, `{part}` binary"
    long = docs.where(F.col(n_bytes) > chunk).withColumn(key, F.sha2(F.encode(text_col, "UTF-8"), 256))
    maps = long.select(key, text_col).mapInArrow(cut, kinds.replace("binary", "string")).dropDuplicates([key, place]).mapInArrow(mapped, kinds)
    for _ in range(3):  # a text has less than 2 GB: 64 ** 3 chunks of 64 KB are 16 GB
        maps = maps.groupBy(key, F.floor(F.col(place) / FAN_IN).alias("run")).applyInArrow(composed, kinds)
    totals = maps.mapInArrow(finished, f"`{key}` string, `{n_tokens}` long")
    joined = long.drop(*dropped).join(totals, key).select(*schema.names)
    return whole.unionByName(joined).withColumn(over, F.col(n_tokens) > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by the 50k file, and which have more than 512. Null text: empty, 0 tokens."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counts(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_text=False)
