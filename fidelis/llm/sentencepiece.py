"""SentencePiece encoding and decoding with a merge-type (BPE) model, by a table of prefixes.

For each prefix of a piece of text there is exactly one token that can end its encoding. ``PrefixTable`` finds it
without merging: an automaton of all pieces gives the tokens that end at a place, and of these the one is right whose
predecessor (the last token of the prefix before it) forms a compatible pair with it. The ids are then read off
backwards. Two tokens are compatible if encoding their joined text gives the two back, which is found once for a pair
by undoing the merges inside the two, and remembered.

No piece of such a model has the blank mark behind another character, so merges never cross into the next blank and a
text is encoded blank by blank. Pieces of two or more blank marks alone share one score, where order of merging is
decided by place; runs of blank marks are therefore encoded by merging, once for each length.

Special input: null is taken as empty, which has no tokens; any other column may be null or have any name; a document
of any length is encoded whole, and what is remembered between words is bounded (``MEMO`` entries a process).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.llm.store import fresh

BLANK = "▁"
#: Stands between words that are encoded together; no piece may hold it.
BREAK = "\n"
MEMO = 200_000
_SEGMENT = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


class PrefixTable:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or spec.treat_whitespace_as_suffix or not spec.byte_fallback:
            raise ValueError("only merge-type models with byte fallback and the identity normaliser are handled")
        self.prefix = BLANK if norm.add_dummy_prefix else ""
        self.ids: dict[str, int] = {}
        self.rank: dict[str, tuple[float]] = {}
        self.byte = [0] * 256
        self.pieces: list[str] = []
        self.is_byte: list[int] = []
        self.silent: set[int] = set()
        for i, p in enumerate(model.pieces):
            self.pieces.append(p.piece)
            self.is_byte.append(-1)
            if p.type == 6:
                b = int(p.piece[3:5], 16)
                self.byte[b], self.is_byte[i] = i, b
            elif p.type == 1:
                self.ids[p.piece], self.rank[p.piece] = i, p.score
            elif p.type == 3:
                self.silent.add(i)
        if any(BREAK in p for p in self.ids):
            raise ValueError("a piece holds the mark between words")
        if any(BLANK in p.lstrip(BLANK) or p[:2] == BLANK * 2 and p.strip(BLANK) for p in self.ids):
            raise ValueError("a piece crosses into the next blank")
        self.unk = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        # Order of merging, and the two tokens whose merge makes a token; single characters are there from the start.
        order = sorted((i for p, i in self.ids.items() if len(p) > 1), key=lambda i: (-self.rank[self.pieces[i]], i))
        self.order = [-1] * len(self.pieces)
        for k, i in enumerate(order):
            self.order[i] = k
        self.left, self.right = [-1] * len(self.pieces), [-1] * len(self.pieces)
        self.size = [len(p) for p in self.pieces] + [1]  # the last is for a character that is no piece, -1
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) > 1 and p.strip(BLANK) and (parts := self.last_merge(p)):
                self.left[i], self.right[i] = (self.ids[x] for x in parts)
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.shown = [p.replace(BLANK, " ") for p in self.pieces]
        for i, b in enumerate(self.is_byte):
            if b >= 0:
                self.shown[i] = bytes([b]).decode("utf-8", "surrogateescape")
        for i in self.silent:
            self.shown[i] = "\udc00"  # can't be encoded
        self.shown[self.unk] = " ⁇ "
        self.decimal = [f",{i}" for i in range(len(self.pieces))]
        self.fits: dict[int, bool] = {}
        self.memo: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.old: dict[str, tuple[str, tuple[int, ...]]] = {}

    def last_merge(self, text: str) -> list[str]:
        """The two pieces that are merged last if ``text`` is encoded as one token; else nothing."""
        steps: list[tuple[str, str]] = []
        return list(steps[-1]) if len(self.merge(text, steps)) == 1 else []

    def merge(self, text: str, steps: list | None = None) -> list[str]:
        """The pieces of ``text`` by carrying out the merges: highest score first, leftmost first among equals."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                both = parts[i] + parts[after[i]]
                if (score := self.rank.get(both)) is not None:
                    heapq.heappush(queue, (-score, i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, both = heapq.heappop(queue)
            if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
                continue
            j = after[i]
            if steps is not None:
                steps.append((parts[i], parts[j]))
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the token ``a`` before the token ``b`` as they are.

        Undoes the merges inside both, latest first. The two stay apart if at no time a merge across their border was
        due before the merge that is being undone: one of equal rank would come first only if it lay further left.
        """
        ids, pieces, order, due = self.ids, self.pieces, self.order, len(self.pieces)
        while True:
            both = ids.get(pieces[a] + pieces[b])
            if both is not None and order[both] < due:
                return False
            if order[a] > order[b]:
                due, a = order[a], self.right[a]
            elif order[b] >= 0:
                due, b = order[b] + 1, self.left[b]
            else:
                return True

    def last_tokens(self, text: str) -> list[int]:
        """The prefix table: for each prefix of ``text``, the last token of its encoding; -1 for a character that is no piece."""
        get, fits, done = self.ids.get, self.fits, -1
        if len(fits) > 5 * MEMO:
            fits.clear()
        known = fits.get
        last = [get(c, -1) for c in text]  # stays where no longer token fits
        last.append(-1)  # before the text
        for end, (piece, size) in self.automaton.iter(text):  # by end; of one end, the longest first
            if end != done:
                before = last[end - size]
                if before >= 0:
                    pair = before << 20 | piece
                    ok = known(pair)
                    if ok is None:
                        ok = fits[pair] = self.compatible(before, piece)
                    if not ok:
                        continue
                last[end] = piece
                done = end
        return last

    def ids_between(self, last: list[int], text: str, start: int, end: int) -> tuple[int, ...]:
        """Ids of ``text[start:end]``, recovered backwards from the prefix table ``last`` of ``text``."""
        size, out = self.size, []
        while end > start:
            i = last[end - 1]
            if i >= 0:
                out.append(i)
                end -= size[i]
            else:
                end -= 1
                out.extend([self.byte[b] for b in reversed(text[end].encode("utf-8"))])
        out.reverse()
        return tuple(out)

    def segment(self, text: str) -> tuple[str, tuple[int, ...]]:
        """Ids of one blank mark run and what follows it: as decimals behind commas, and as numbers."""
        blanks = max(1, len(text) - len(text.lstrip(BLANK)))
        tail = text[blanks - 1 :]
        ids, run = self.ids_between(self.last_tokens(tail), tail, 0, len(tail)), blanks - 1
        if run:
            if ids[0] == self.ids.get(BLANK, -1):  # the last blank has joined no letter
                ids, run = ids[1:], blanks
            ids = (*(self.ids[p] for p in self.merge(BLANK * run)), *ids)
        return "".join([self.decimal[i] for i in ids]), ids

    def learn(self, words: list[str]) -> None:
        """Remembers the ids of each word with a blank before it; all words share one pass of the automaton."""
        text = BREAK.join([BLANK + w for w in words])  # no piece holds the break, so no token reaches over it
        last, decimal, memo, start = self.last_tokens(text), self.decimal, self.memo, 0
        for w in words:
            end = start + len(w) + 1
            ids = self.ids_between(last, text, start, end)
            memo[w] = "".join([decimal[i] for i in ids]), ids
            start = end + 1

    def segments(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        if not text:
            return []
        if self.prefix and BLANK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            words = text.split(" ")
            if len(self.memo) > MEMO:
                self.old, self.memo = self.memo, {}
            memo, old = self.memo, self.old
            new = []
            for w in set(words).difference(memo):
                if w in old:
                    memo[w] = old[w]
                else:
                    new.append(w)
            if new:
                self.learn(new)
            return [memo[w] for w in words]
        return [self.segment(s) for s in _SEGMENT.findall(self.prefix + text.replace(" ", BLANK))]

    def encode(self, text: str | None) -> list[int]:
        return [i for _, ids in self.segments(text or "") for i in ids]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The decoded text in UTF-8: blank marks become blanks, the one put before the text goes, bytes that are no UTF-8 become U+FFFD."""
        shown = self.shown
        text = "".join([shown[i] for i in ids])
        first = next((i for i in ids if i not in self.silent), -1) if self.prefix else -1
        if first >= 0 and self.is_byte[first] < 0 and self.pieces[first].startswith(BLANK):
            text = text.replace(" ", "", 1)
        if text.isascii():
            return text.encode()
        try:
            raw = text.encode("utf-8", "surrogateescape")
        except UnicodeEncodeError:  # tokens that show nothing end a run of bytes
            return b"".join(_valid(x.encode("utf-8", "surrogateescape")) for x in text.split("\udc00"))
        return _valid(raw)

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8")


def _valid(raw: bytes) -> bytes:
    """``raw`` with U+FFFD for each byte that belongs to no character of UTF-8."""
    try:
        raw.decode("utf-8")
        return raw
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode("utf-8"))
                    i += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("\ufffd")
                i += 1
        return "".join(out).encode("utf-8")


_tables: dict[str, PrefixTable] = {}


def table(model_file: str) -> PrefixTable:
    """The encoder of a model file, made once a process."""
    if model_file not in _tables:
        _tables[model_file] = PrefixTable(model_file)
    return _tables[model_file]


def encoded(df: DataFrame, model_file: str, text: str = "text", ids: bool = False, drop_text: bool = True) -> DataFrame:
    """``df`` without ``text`` (unless kept) and with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    One narrow pass. Columns of ``df`` that have one of these names are replaced.
    """
    new = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + [("ids", "array<int>")] * ids
    kept = [c for c in df.columns if c not in {n for n, _ in new} and not (drop_text and c == text)]
    source = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias(*fresh(df, "encode")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(model_file)
        for batch in batches:
            counts, shas, backs, lists = [], [], [], []
            for x in batch.column(len(kept)).to_pylist():
                got = t.segments(x or "")
                numbers = [i for _, more in got for i in more]
                counts.append(len(numbers))
                shas.append(hashlib.sha256("".join([g for g, _ in got])[1:].encode()).hexdigest())
                backs.append(hashlib.sha256(t.decode_bytes(numbers)).hexdigest())
                if ids:
                    lists.append(numbers)
            out = [*batch.columns[: len(kept)], pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(lists, pa.list_(pa.int32()))] * ids, names=[*kept, *(n for n, _ in new)])

    schema = source.select(*(F.col(f"`{c}`") for c in kept)).schema
    for n, kind in new:
        schema = schema.add(n, T.ArrayType(T.IntegerType()) if n == "ids" else kind)
    return source.mapInArrow(run, schema)


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(d, public_tokenizers.path("piece_bpe_32k.model"))
