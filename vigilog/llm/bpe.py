"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece the canonical BPE encoding has exactly one last
token.  ``last[i]`` stores it, so the encoding of any prefix is read back by
walking the table, an append only extends it, and after an edit only the
entries near the edit change.  A token ``t`` over ``piece[j:i]`` is the last one
of prefix ``i`` exactly if it may follow ``last[j]``, i.e. if merging the bytes
of both tokens alone gives these two tokens again.

Nulls encode as the empty text (no ids); repeated rows and repeated ids give
one output row each; texts and pieces of any length are encoded whole; other
input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: Pieces in each of the two generations remembered per Python worker; a speed bound only, longer ones are encoded anew.
CACHE_PIECES = 150_000
#: Pairs of tokens remembered per worker.
CACHE_PAIRS = 300_000
#: Token ids are below this.
IDS = 1 << 32
CACHE_PIECE_BYTES = 64
#: Texts are encoded in groups of about this many characters.
GROUP_CHARS = 1_000_000


class PrefixBpe:
    """Encoder over ``ranks`` (token bytes to id, lower ids merge first)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: By left * IDS + right: whether the right token may follow the left one.
        self._follows: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain rank-order merging, for two-token strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        key = left * IDS + right
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) > CACHE_PAIRS:
                self._follows.clear()
            known = self._follows[key] = self.merge(self.token_bytes[left] + self.token_bytes[right]) == [left, right]
        return known

    def last_token(self, data: bytes, i: int, last: list[int]) -> int:
        get, known = self.ranks.get, self._follows.get
        # only one candidate is valid, so the order is free: it is mostly a short one
        for j in range(i - 1, (i - self.longest if i > self.longest else 0) - 1, -1):
            t = get(data[j:i])
            if t is not None:
                if j == 0:
                    return t
                ok = known(last[j] * IDS + t)
                if ok or (ok is None and self.follows(last[j], t)):
                    return t
        raise ValueError("the vocabulary lacks a single byte")

    def encode_sorted(self, pieces: list[bytes]) -> list[str]:
        """The ids, joined by spaces, of sorted pieces, each from the table of the prefix it shares with the one before.

        As ``last_token`` for each prefix, written out, with the ids of the prefixes beside the table.
        """
        get, known, follows, longest = self.ranks.get, self._follows.get, self.follows, self.longest
        out, before, last, texts = [], b"", [-1], [""]
        for data in pieces:
            whole = get(data)
            if whole is not None:
                out.append(str(whole))
                continue
            size = len(data)
            n = min(len(before), size)
            same = n if before[:n] == data[:n] else next(k for k in range(n) if before[k] != data[k])
            del last[same + 1 :], texts[same + 1 :]
            for i in range(same + 1, size + 1):
                for j in range(i - 1, (i - longest if i > longest else 0) - 1, -1):
                    t = get(data[j:i])
                    if t is not None:
                        if not j:
                            last.append(t)
                            texts.append(str(t))
                            break
                        left = last[j]
                        ok = known(left * IDS + t)
                        if ok or (ok is None and follows(left, t)):
                            last.append(t)
                            texts.append(f"{texts[j]} {t}")
                            break
                else:
                    raise ValueError("the vocabulary lacks a single byte")
            before = data
            out.append(texts[size])
        return out

    def table(self, data: bytes) -> list[int]:
        last = [-1] * (len(data) + 1)
        for i in range(1, len(data) + 1):
            last[i] = self.last_token(data, i, last)
        return last

    def read(self, last: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i:
            out.append(last[i])
            i -= len(self.token_bytes[last[i]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.read(self.table(data))

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The table of ``data + more`` from the table of ``data``."""
        return self.edit(data, last, len(data), len(data), more)

    def edit(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """The table after ``data[start:end]`` became ``new``.

        Entries up to ``start`` stay; from there on they are computed until one
        token length in a row agrees with the old table past the edit, after
        which all later entries are the old ones.
        """
        out = data[:start] + new + data[end:]
        table, shift, same = last[: start + 1], len(new) - (end - start), 0
        for i in range(start + 1, len(out) + 1):
            table.append(self.last_token(out, i, table))
            old = i - shift
            same = same + 1 if i - same > start + len(new) and table[i] == last[old] else 0
            if same > self.longest:
                return out, table + last[old + 1 :]
        return out, table


class Remembered:
    """The ids of pieces, joined by spaces, in two generations of about ``limit`` pieces.

    When the young one is full the old one goes and the young one ages; a piece that is
    met again comes back from the old one, so frequent pieces are encoded once.
    """

    def __init__(self, bpe: PrefixBpe, limit: int):
        self.bpe, self.limit = bpe, limit
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def learn(self, pieces: set[str]) -> None:
        """Have all of ``pieces`` in the young generation, but those longer than CACHE_PIECE_BYTES."""
        if len(self.young) + len(pieces) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        unknown = [p for p in pieces if p not in young and len(p) <= CACHE_PIECE_BYTES]
        young.update((p, old[p]) for p in unknown if p in old)
        missing = sorted((p.encode(), p) for p in unknown if p not in old)
        young.update(zip((p for _, p in missing), self.bpe.encode_sorted([b for b, _ in missing]), strict=True))


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A tiktoken rank file (bounded by its vocabulary) from the driver's disk."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}


_worker: dict = {}


def _encoder(key, ranks):
    if _worker.get("key") != key:
        _worker.clear()
        _worker.update(key=key, cache=Remembered(PrefixBpe(ranks), CACHE_PIECES), decode={str(i): b for b, i in ranks.items()})
    return _worker


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode whole texts: id_col, ids (array, if ``with_ids``), n_tokens, ids_sha256, decoded_sha256.

    ``decoded_sha256`` is taken over the bytes decoded from the ids.  The
    vocabulary is broadcast; its size is that of the rank file.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    digest = hashlib.sha256(repr(sorted(ranks.items())[:50]).encode() + str(len(ranks)).encode()).hexdigest()
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, " + ("ids array<int>, " if with_ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import regex

        state = _encoder(digest, shared.value)
        cache, token_of = state["cache"], state["decode"]
        find = regex.compile(pattern).findall
        sha = hashlib.sha256

        def groups(column):
            held, size = [], 0
            for text in column:
                held.append(find(text or ""))
                size += len(text or "")
                if size >= GROUP_CHARS:
                    yield held
                    held, size = [], 0
            yield held

        def long_ids(piece: str) -> str:
            return " ".join(map(str, cache.bpe.encode_piece(piece.encode())))

        for batch in batches:
            names = batch.schema.names
            row = 0
            for group in groups(batch.column(names.index("_text")).to_pylist()):
                cache.learn(set().union(*group))
                get = cache.young.get
                id_parts, n, enc, dec = [], [], [], []
                for pieces in group:
                    joined = " ".join([get(p) or long_ids(p) for p in pieces])
                    ids = joined.split(" ") if joined else []
                    n.append(len(ids))
                    if with_ids:
                        id_parts.append(np.array(ids, np.int32))
                    enc.append(sha(joined.encode()).hexdigest())
                    dec.append(sha(b"".join([token_of[i] for i in ids])).hexdigest())
                columns = [batch.column(names.index("_id")).slice(row, len(group))]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*id_parts, np.zeros(0, np.int32)]))))
                columns += [pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())]
                row += len(group)
                yield pa.RecordBatch.from_arrays(columns, names=[id_col] + (["ids"] if with_ids else []) + ["n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes of an id array as ``out_col`` (null ids: empty)."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def bytes_of(ids):
        token = {i: b for b, i in shared.value.items()}
        return ids.map(lambda x: b"" if x is None else b"".join(token[int(i)] for i in x))

    return df.withColumn(out_col, bytes_of(F.col(ids_col)))
