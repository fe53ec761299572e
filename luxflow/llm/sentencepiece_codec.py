"""SentencePiece BPE in numpy: vectorised merge rounds over flat symbol arrays, and the way back.

A text is cut where no piece of the vocabulary can span the cut, so words are
independent; each distinct word of a batch is merged once and held in a bounded cache.
A round finds the best pair rank of every unfinished word by a segmented minimum,
merges its leftmost occurrences at once, and compacts the arrays, until no pair is left.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import WordCache, columns, texts_of, thrifty, worker_held

NONE = np.int64(1 << 40)
SPACE = "▁"


class Codec:
    """Encodes and decodes as the sentencepiece library does for a BPE model with identity normalisation."""

    def __init__(self, path: str, cache: int = 64 << 20):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        if sp.normalize("a éﬁ  b") != f"{SPACE}a{SPACE}éﬁ{SPACE}{SPACE}b":
            raise ValueError("only models with identity normalisation and a dummy prefix are read")
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        pieces = [sp.id_to_piece(i) for i in range(size)]
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.ids = {p.replace(SPACE, " "): i for i, p in enumerate(pieces) if not special[i]}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.is_byte = {i: b for b, i in enumerate(self.byte_ids)}
        self.surface = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([self.is_byte[i]]) if i in self.is_byte else pieces[i].replace(SPACE, " ").encode() for i in range(size)]
        self.led = [not special[i] and pieces[i].startswith(SPACE) for i in range(size)]
        self.silent = {i for i in range(size) if sp.is_control(i)}
        symbols = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p} - symbols.keys()):
            symbols[c] = len(symbols) + size  # only met inside longer pieces
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True))}
        found = [(symbols[p[:k]] << 20 | symbols[p[k:]], order[sp.get_score(i)], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        table = np.array(sorted(found), np.int64).reshape(-1, 3)
        self.pair, self.rank, self.merged = (np.ascontiguousarray(table[:, i]) for i in range(3))
        self.symbol = {c: i for c, i in symbols.items() if len(c) == 1}
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        spans = any(a != " " == b for p in self.ids for a, b in zip(p, p[1:], strict=False))
        self.words = re.compile(r"(?s).+" if spans else r" *[^ \n]+| +|\n+" if "\n" not in inner else r" *[^ ]+| +")
        self.cache = WordCache(cache)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no such piece) and id of the piece that two symbols make."""
        key = left << 20 | right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.rank[at], NONE), self.merged[at]

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids, little-endian unsigned 32-bit."""
        if not words:
            return []
        get = self.symbol.get
        flat = "".join(words)
        known: dict[str, int] = {c: get(c, -1 - ord(c)) for c in set(flat)}
        sym = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done_sym, done_word = [], []
        rank = merged = None
        while len(sym):
            n = len(sym)
            if rank is None:
                rank, merged = np.full(n, NONE), np.zeros(n, np.int64)
                stale = np.arange(n - 1)
            stale = stale[word[stale] == word[stale + 1]]
            rank[stale], merged[stale] = self._ranks(sym[stale], sym[stale + 1])
            first = np.concatenate([[True], word[1:] != word[:-1]])
            starts = np.nonzero(first)[0]
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, n)))
            if (over := best == NONE).any():  # finished words leave the arrays
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, rank, merged, best, first = (x[keep] for x in (sym, word, rank, merged, best, first))
                n = len(sym)
                if not n:
                    break
            at = np.nonzero(rank == best)[0]
            # leftmost and not overlapping: of a run of touching places every other one
            run = np.concatenate([[True], (np.diff(at) != 1) | first[at[1:]]])
            head = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
            new, own = merged[at], word[at]
            touching = np.concatenate([[False], np.diff(at) == 2]) & ~first[at]
            before = np.where(touching, np.concatenate([[0], new[:-1]]), sym[np.maximum(at - 1, 0)])
            before[first[at]] = -1
            after_at = np.minimum(at + 2, n - 1)
            after = np.where((at + 2 < n) & (word[after_at] == own), sym[after_at], -1)
            # a merge that makes a pair as good as its own is that word's last one in this round
            ends = np.minimum(self._ranks(before, new)[0], self._ranks(new, after)[0]) <= best[at]
            passed = np.cumsum(ends) - ends
            lead = np.concatenate([[True], own[1:] != own[:-1]])
            base = np.repeat(passed[lead], np.diff(np.append(np.nonzero(lead)[0], len(at))))
            at, new = (x[passed == base] for x in (at, new))
            sym[at] = new
            rank[at] = NONE
            left = at[~first[at]] - 1
            rank[left] = NONE
            keep = np.ones(n, bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, rank, merged = (x[keep] for x in (sym, word, rank, merged))
            # the symbol before may itself have been merged into an earlier one
            stale = np.concatenate([place[at], place[left]])
            rank[stale] = NONE
            stale = stale[stale < len(sym) - 1]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        if (odd := (sym < 0) | (sym >= len(self.surface))).any():
            back = {i: c for c, i in self.symbol.items() if i >= len(self.surface)}
            out, at_word = [], []
            for s, w, o in zip(sym.tolist(), word.tolist(), odd.tolist(), strict=True):
                now = [self.byte_ids[b] for b in (chr(-1 - s) if s < 0 else back[s]).encode("utf-8", "surrogatepass")] if o else [s]
                out += now
                at_word += [w] * len(now)
            sym, word = np.array(out, np.int64), np.array(at_word, np.int64)
        raw = sym.astype("<u4").tobytes()
        cuts = (np.searchsorted(word, np.arange(len(words) + 1)) * 4).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode_raw(self, texts: list[str]) -> list[bytes]:
        """Ids without begin and end, little-endian unsigned 32-bit, of each text."""
        split = [self.words.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        cache = self.cache
        missing = cache.missing(set().union(*split))
        for i in range(0, len(missing), 20_000):
            part = missing[i : i + 20_000]
            cache.add(part, self.merge_words(part))
        out = [b"".join(map(cache.__getitem__, s)) for s in split]
        cache.trim()
        return out

    def encode(self, texts: list[str], bos: bool = True, eos: bool = True) -> list[np.ndarray]:
        head, tail = (np.array([x] if y else [], "<u4").tobytes() for x, y in ((self.bos, bos), (self.eos, eos)))
        return [np.frombuffer(head + raw + tail, "<u4") for raw in self.encode_raw(texts)]

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if i not in self.silent), None)
        lead = first is not None and self.led[first]
        try:
            text = out.decode()
        except UnicodeDecodeError:
            text = self._decode_broken(ids)
        return text[1:] if lead else text

    def _decode_broken(self, ids: list[int]) -> str:
        """As decode, where runs of byte pieces aren't UTF-8: each byte that starts no character becomes U+FFFD."""
        out, run = [], bytearray()

        def flush() -> None:
            raw = bytes(run)
            run.clear()
            at = 0
            while at < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[at : at + n].decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1

        for i in ids:
            if i in self.is_byte:
                run.append(self.is_byte[i])
            else:
                flush()
                out.append(self.surface[i].decode())
        flush()
        return "".join(out)


def codec_of(path: str) -> Codec:
    """One per Python worker, so that its tasks share what they have merged."""
    return worker_held(("sentencepiece", path), lambda: Codec(path))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per input row, whole texts.

    Null texts are empty, and an empty text is its begin and end ids. model: path of a
    SentencePiece BPE model that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        head, tail = np.array([codec.bos], "<u4").tobytes(), np.array([codec.eos], "<u4").tobytes()
        for ids, texts in columns(batches, "doc_id", "text"):
            out: tuple[list, ...] = ([], [], [])
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < 1_000_000:
                    size += len(texts[end])
                    end += 1
                for raw in codec.encode_raw(texts[at:end]):
                    raw = head + raw + tail
                    tokens = np.frombuffer(raw, "<u4").tolist()
                    out[0].append(len(tokens))
                    out[1].append(hashlib.sha256(raw).hexdigest())
                    out[2].append(hashlib.sha256(codec.decode(tokens).encode("utf-8", "surrogatepass")).hexdigest())
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs).mapInArrow(thrifty(run, "sentencepiece"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
