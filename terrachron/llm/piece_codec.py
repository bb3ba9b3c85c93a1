"""SentencePiece (merge type) encoding by a prefix table, and decoding.

Merging never crosses a border between two characters that no piece holds side by side, so texts
fall into words, and the ids of a word do not depend on its neighbours. Within a word the encoder
keeps, for each prefix, the last token of that prefix's encoding. It is unique: among the pieces
that end there (found by an automaton), exactly one follows the last token of the prefix before it
so that merging would leave the border between the two open. Ids are recovered backwards.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy

SPACE = "▁"
#: Words, and units of words, that a worker remembers; a table is emptied when full.
CACHED_WORDS = 200_000
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_UNIT = re.compile(f"{SPACE}?(?:[{_LATIN}]+|[^{_LATIN}{SPACE}]+)|{SPACE}")
_NORMAL, _UNKNOWN, _BYTE, _CONTROL = 1, 2, 6, 3


class Pieces:
    """The pieces of a merge-type model, their ranks, last merges and automaton."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap:
            raise ValueError("a merge-type model without character normalisation is needed")
        if not model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a model that adds one leading space and keeps all others is needed")
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.surface: list[str | int | None] = []  # text, byte value, or nothing
        self.byte: dict[int, int] = {}
        self.unknown = 0
        for i, piece in enumerate(model.pieces):
            if piece.type == _NORMAL:
                self.ids[piece.piece], self.rank[piece.piece] = i, -piece.score
                self.surface.append(piece.piece.replace(SPACE, " "))
            elif piece.type == _BYTE:
                value = int(piece.piece[3:5], 16)
                self.byte[value] = i
                self.surface.append(value)
            else:
                self.unknown = i if piece.type == _UNKNOWN else self.unknown
                self.surface.append(model.trainer_spec.unk_surface if piece.type == _UNKNOWN else None)
        self.runs = {len(p) for p in self.ids if p.strip(SPACE) == ""}
        words = [p for p in self.ids if p.strip(SPACE)]
        if any(SPACE in p[1:] for p in words):
            raise ValueError("pieces must have a space only in front")
        #: Letters of Latin script can be parted from other characters if no piece holds both.
        self.parted = all(_UNIT.fullmatch(p) for p in words)
        self.split: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in [*words, SPACE]:
            if p in self.ids and (len(p) == 1 or self._derive(p)):
                # With the tokens that it may or may not follow; None: a text's start, or a character in no piece.
                self.automaton.add_word(p, (p, len(p), str(self.ids[p]), {None: True}))
        self.automaton.make_automaton()

    def _derive(self, piece: str) -> bool:
        """Whether merging the piece's own characters gives the piece; notes its last merge."""
        parts = list(piece)
        while len(parts) > 1:
            options = [(self.rank[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.rank]
            if not options:
                return False
            i = min(options)[1]
            if len(parts) == 2:
                self.split[piece] = (parts[0], parts[1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return True

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both leaves exactly these two tokens.

        Undoes the merges of the two tokens, last one first; the pair at the border must at no
        time have been the better merge. Of equal ranks the left one is merged first.
        """
        x, y, rank, limit = left, right, self.rank, float("inf")
        while True:
            crossing = rank.get(x + y)
            if crossing is not None and crossing < limit:
                return False
            made_x = rank[x] if len(x) > 1 else -1.0
            made_y = rank[y] if len(y) > 1 else -1.0
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                limit, x = made_x, self.split[x][1]
            else:
                limit, y = made_y + 0.5, self.split[y][0]


class Codec:
    """encode(text) -> ids and decode(ids) -> text."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.units = _Remembered(self.unit)
        self.words = _Remembered(self.word)
        self.surfaces = _Surfaces(self.pieces.surface)

    def _fallback(self, char: str) -> list[int]:
        p = self.pieces
        return [p.byte[b] for b in char.encode()] if p.byte else [p.unknown]

    def unit(self, text: str) -> str:
        """Ids of characters that hold no space but in front, as decimal numbers joined by commas."""
        compatible = self.pieces.compatible
        last: list[str | None] = [None] * (len(text) + 1)  # by prefix; None where its last character is in no piece
        step: list[tuple[int, str] | None] = last.copy()
        for end, (piece, size, number, fits) in self.pieces.automaton.iter(text):
            end += 1
            if last[end] is None:
                before = last[end - size]
                fit = fits.get(before)
                if fit is None:
                    fit = fits[before] = compatible(before, piece)
                if fit:
                    last[end], step[end] = piece, (size, number)
        out, at = [], len(text)
        while at:
            found = step[at]
            if found is None:
                at -= 1
                out.append(",".join(map(str, self._fallback(text[at]))))
            else:
                at -= found[0]
                out.append(found[1])
        out.reverse()
        return ",".join(out)

    def word(self, text: str) -> str:
        """Ids of a word with one space in front."""
        if not self.pieces.parted:
            return self.unit(SPACE + text)
        return ",".join(map(self.units.__getitem__, _UNIT.findall(SPACE + text)))

    def run(self, n: int) -> list[int]:
        """Ids of ``n`` spaces: runs have equal ranks, so the leftmost pair merges first."""
        p, stack = self.pieces, []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in p.runs:
                top = stack.pop()
                stack[-1] += top
        return [i for k in stack for i in ([p.ids[SPACE * k]] if SPACE * k in p.ids else self._fallback(SPACE) * k)]

    def text_ids(self, text: str) -> list[str]:
        """Ids as decimal numbers joined by commas, one string per word or run of spaces."""
        if not text:
            return []
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            return list(map(self.words.__getitem__, words))
        alone = str(self.pieces.ids[SPACE])
        out, spaces = [], 0
        for w in words:
            if w == "":
                spaces += 1
                continue
            ids = self.words[w]
            if spaces:
                head, _, rest = ids.partition(",")
                if head == alone:  # the space in front joins no letter, so it belongs to the run
                    out.append(",".join(map(str, self.run(spaces + 1))))
                    ids = rest
                else:
                    out.append(",".join(map(str, self.run(spaces))))
                spaces = 0
            out.append(ids)
        if spaces:
            out.append(",".join(map(str, self.run(spaces))))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.text_ids(text) for i in part.split(",")]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces in a row are UTF-8; a space that leads the first piece is the model's own."""
        out, run = [], bytearray()
        surface, first = self.pieces.surface, True
        for i in ids:
            s = surface[i]
            if isinstance(s, int):
                run.append(s)
                first = False
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if s is not None:
                out.append(s[1:] if first and i != self.pieces.unknown and s.startswith(" ") else s)
                first = False
        if run:
            out.append(_utf8(run))
        return "".join(out)


    def decode_decimals(self, parts: list[str]) -> str:
        """What ``decode`` gives for the ids of all parts, each decimal numbers joined by commas.

        Bytes of ids add up, so the bytes of each part are joined and read as UTF-8 at once. Lists that
        begin with a piece without text, or whose bytes are no UTF-8, are left to ``decode``.
        """
        if not parts:
            return ""
        first = int(parts[0].partition(",")[0])
        surface = self.pieces.surface[first]
        if surface is not None and first != self.pieces.unknown:
            try:
                text = b"".join(map(self.surfaces.__getitem__, parts)).decode()
            except UnicodeDecodeError:
                pass
            else:
                return text[1:] if isinstance(surface, str) and surface.startswith(" ") else text
        return self.decode([int(i) for part in parts for i in part.split(",")])


def _utf8(run: bytearray) -> str:
    """Bytes as text; each byte that is no part of a character gives one U+FFFD."""
    out, at = [], 0
    raw = bytes(run)
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


class _Remembered(dict):
    """Ids of words or units as text, made when first asked for."""

    def __init__(self, ids_of: Callable[[str], str]):
        self.ids_of = ids_of

    def __missing__(self, text: str) -> str:
        found = self.ids_of(text)
        if len(text) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[text] = found
        return found


class _Surfaces(dict):
    """Bytes that ids decode to, by the ids of a word as text; made from each id when first asked for."""

    def __init__(self, surface: list[str | int | None]):
        self.bytes_of = {
            str(i): b"" if s is None else bytes((s,)) if isinstance(s, int) else s.encode()
            for i, s in enumerate(surface)
        }

    def __missing__(self, ids: str) -> bytes:
        found = b"".join(map(self.bytes_of.__getitem__, ids.split(",")))
        if len(ids) <= 256:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[ids] = found
        return found


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a model file, kept by the worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


#: Rows whose results are handed back together.
SLICE_ROWS = 256


def _coder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                ids, counts, back = [], [], []
                for text in batch.column("text").to_pylist():
                    text = text or ""
                    parts = c.text_ids(text)
                    joined = ",".join(parts)
                    ids.append(joined)
                    counts.append(joined.count(",") + 1 if joined else 0)
                    back.append(c.decode_decimals(parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                    ["id", "n_tokens", "ids", "decoded"],
                )

    return tidy(run)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) of every whole text; a scan without a shuffle.

    ``ids`` are decimal numbers joined by commas, ``decoded`` is the text of those ids. ``model`` is
    the path of a merge-type model file that every executor has.

    Defined cases: a null or empty text has no ids and decodes to the empty text; characters outside
    the model become byte pieces; U+2581 in a text counts as a space, as in the library; ids may be
    null or repeated; time and memory grow with the length of a text, words of any length included.
    """
    rows = ship(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    found = rows.mapInArrow(_coder(model), f"id {kind}, n_tokens bigint, ids string, decoded string")
    return found.select(F.col("id").alias(id_col), "n_tokens", "ids", "decoded")


def op8_piece_codec(spark, sf_dir):
    """Ids and decoded texts of the whole documents table, as digests."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
