"""Token-id output: texts to ids, written as coded segment files with a shared frequency table, and read back.

Texts are ordered by id (ranges of ids are tasks).  A segment holds whole documents; its file is

    b"TKS1", u32 header length, zlib(JSON header), then per block: lane states, words

The header names the table's checksum, the documents (ids, lengths) and the blocks (ids, words, checksum).
"""

from __future__ import annotations

import json
import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rans
from .common import scratch, table
from .hashing import small_batches
from .shared import attempt_name, forget, make_folder, partition_id, place, read_range

SEGMENT_IDS = 4_000_000
PART_BYTES = 6_000_000
CACHE_WORDS = 1_600_000
END_ID = 1
TOGETHER = 64
# ASCII signs that the split rule keeps apart from letters; the apostrophe starts contractions and is not one.
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
MAGIC = b"TKS1"


class WordIds(dict):
    """Packed ids by word (bytes between ASCII white space).

    The tokenizer drops white space and never joins what it separates, so a text's ids are its words' ids in
    order.  With ``suffix``, the mark of a word's last token, letters and the signs behind them are looked up
    apart and unknown letter words are encoded many at a time.
    """

    def __init__(self, tokenizer, kind: str, suffix: str | None, most: int = CACHE_WORDS):
        self.tokenizer, self.kind, self.suffix, self.most = tokenizer, kind, suffix, most
        self.letter_end: dict[str, bool] = {}
        if suffix:
            vocab = tokenizer.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            # same model without normal form and split rule, for words that these leave as they are
            from tokenizers import Tokenizer, normalizers, pre_tokenizers

            self.quick = Tokenizer.from_str(tokenizer.to_str())
            self.quick.normalizer = normalizers.Sequence([])
            self.quick.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _each(self, words: list[bytes]) -> dict[bytes, bytes]:
        got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return {w: np.array(e.ids, self.kind).tobytes() for w, e in zip(words, got)}

    def _letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words of letters, in lower case where they are ASCII."""
        out = self._joined(self.quick, [w for w in words if w.isascii()])
        return out | self._joined(self.tokenizer, [w for w in words if not w.isascii()])

    def _joined(self, tokenizer, words: list[bytes]) -> dict[bytes, bytes]:
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        got = tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)
        out = {}
        for group, e in zip(groups, got):
            ids = np.array(e.ids, self.kind)
            ends = (np.nonzero(self.last[ids])[0] + 1) * ids.itemsize
            if len(ends) != len(group):  # not one run of letters each after all
                out |= self._each(group)
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(group, ends.tolist()):
                out[w] = raw[at:end]
                at = end
        return out

    def of(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Packed ids of all ``words``; new ones are remembered while there is room (frequent words come early)."""
        known = list(words & self.keys())
        out = dict(zip(known, map(self.__getitem__, known)))
        new = words.difference(out)
        made = self._each(list(new)) if not self.suffix else self._apart(new)
        out.update(made)
        if len(self) < self.most:
            self.update(made)
        return out

    def _ends_in_letter(self, base: str) -> bool:
        """Letters only, and the last one still ends in a letter in normal form: signs behind a mark would belong to its run."""
        if not base.isalpha():
            return False
        last = base[-1]
        if last not in self.letter_end:
            normal = self.tokenizer.normalizer
            self.letter_end[last] = (normal.normalize_str(last) if normal else last)[-1:].isalpha()
        return self.letter_end[last]

    def _apart(self, words: set[bytes]) -> dict[bytes, bytes]:
        letters, other, split = set(), [], []
        for w in words:
            base = w.rstrip(SIGNS)
            if base and (base.isalpha() or not base.isascii() and self._ends_in_letter(base.decode("utf-8", "replace"))):
                low = base.lower()
                split.append((w, low, w[len(base) :]))
                letters.add(low)
            else:
                other.append(w)
        tails = {tail for _, _, tail in split}
        made = self._each(list(tails.union(other)))
        out = {w: made[w] for w in other}
        heads = [w for w in letters if w not in self]
        ids = self._letters(heads)
        for w, low, tail in split:
            head = ids[low] if low in ids else self[low]
            out[w] = head + made[tail] if tail else head
        return out


def word_ids(path: str, most: int = CACHE_WORDS) -> WordIds:
    """The words' ids of a tokenizer file, kept for the life of a Python worker; about ``most`` are remembered."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    memo = sys.modules.setdefault("_word_id_memo", types.ModuleType("_word_id_memo"))
    if getattr(memo, "made_for", None) != (path, most):
        t = Tokenizer.from_file(path)
        kind = "<u2" if t.get_vocab_size() <= 1 << 16 else "<u4"
        probe = lambda s: t.encode(s, add_special_tokens=False).ids
        if probe("ab  c\nd") != probe("ab") + probe("c") + probe("d"):
            raise ValueError("this tokenizer keeps white space; words cannot be encoded one by one")
        byte_level = "ByteLevel" in repr(t.pre_tokenizer)
        apart = byte_level and probe("Abc,.") == probe("abc") + probe(",.")
        memo.made_for, memo.ids = (path, most), WordIds(t, kind, getattr(t.model, "end_of_word_suffix", None) if apart else None, most)
    return memo.ids


def segments(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID, segment_ids: int = SEGMENT_IDS, remembered: int = CACHE_WORDS) -> DataFrame:
    """(shard, seg, ids of documents as JSON, lengths, packed ids, width, id counts) in ascending order of ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, shard, seg = word_ids(tokenizer, remembered), partition_id(), 0
        size = np.dtype(cache.kind).itemsize
        end = b"" if end_id is None else np.array([end_id], cache.kind).tobytes()
        names, lens, parts, held = [], [], [], 0

        def flush() -> pd.DataFrame:
            ids = b"".join(parts)
            counts = np.bincount(np.frombuffer(ids, cache.kind)).astype("<u4").tobytes()
            return pd.DataFrame({"shard": [shard], "seg": [seg], "names": [json.dumps(names)], "lens": [lens], "ids": [ids], "width": [size], "counts": [counts]})

        for batch in batches:
            for part in small_batches(batch, "raw", PART_BYTES):
                lists = [raw.split() if raw else [] for raw in part["raw"]]
                ids_of = cache.of(set().union(*lists)).__getitem__
                for name, ws in zip(part["name"], lists):
                    packed = b"".join(map(ids_of, ws)) + end
                    names.append(name)
                    lens.append(len(packed) // size)
                    parts.append(packed)
                    held += lens[-1]
                    if held >= segment_ids:
                        yield flush()
                        names, lens, parts, held, seg = [], [], [], 0, seg + 1
        if names:
            yield flush()

    d = docs.repartitionByRange(F.col("doc_id"), F.col("th")).sortWithinPartitions("doc_id", "th")
    d = d.select(F.col("doc_id").cast("string").alias("name"), "raw")
    return d.mapInPandas(run, "shard int, seg int, names string, lens array<int>, ids binary, width int, counts binary")


def id_counts(segs: DataFrame) -> DataFrame:
    """(id, n) over all segments, summed per task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch["counts"]:
                c = np.frombuffer(raw, "<u4").astype(np.int64)
                total, c = (total, c) if len(total) >= len(c) else (c, total)
                total[: len(c)] += c
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"id": at, "n": total[at]})

    return segs.select("counts").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(segs: DataFrame, folder: str, freq: np.ndarray) -> DataFrame:
    """One file per segment; returns (shard, seg, file, n_ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        code = rans.Table(freq)
        system, root = place(folder)
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                ids = np.frombuffer(r.ids, f"<u{r.width}")
                blocks = rans.encode(ids, code)
                head = {"table": code.crc, "names": json.loads(r.names), "lens": list(map(int, r.lens)), "blocks": [[b[0], len(b[2]), b[3]] for b in blocks]}
                packed = zlib.compress(json.dumps(head).encode())
                name = attempt_name(f"seg-{r.shard:06d}-{r.seg:06d}") + ".tks"
                with system.open_output_stream(f"{root}/{name}") as f:
                    f.write(MAGIC + len(packed).to_bytes(4, "little") + packed)
                    for b in blocks:
                        f.write(b[1] + b[2])
                rows.append((r.shard, r.seg, f"{folder}/{name}", len(ids)))
            yield pd.DataFrame(rows, columns=["shard", "seg", "file", "n_ids"])

    return segs.drop("counts").mapInPandas(run, "shard int, seg int, file string, n_ids long")


def read_file(file: str, code: rans.Table) -> tuple[list, list[int], np.ndarray]:
    """(document ids as text, lengths, all ids) of a segment file."""
    system, path = place(file)
    with system.open_input_file(path) as f:
        raw = f.read()
    if raw[:4] != MAGIC:
        raise ValueError(f"not a segment file: {file}")
    at = 8 + int.from_bytes(raw[4:8], "little")
    head = json.loads(zlib.decompress(raw[8:at]))
    if head["table"] != code.crc:
        raise ValueError(f"another frequency table: {file}")
    blocks = []
    for n, size, crc in head["blocks"]:
        mid = at + 8 * rans.LANES
        blocks.append((n, raw[at:mid], raw[mid : mid + size], crc))
        at = mid + size
    return head["names"], head["lens"], rans.decode(blocks, code)


def read_block(file: str, index: int, code: rans.Table) -> np.ndarray:
    """The ids of one block by range reads, without the blocks before it."""
    size = int.from_bytes(read_range(file, 4, 4), "little")
    head = json.loads(zlib.decompress(read_range(file, 8, size)))
    at = 8 + size + sum(8 * rans.LANES + b[1] for b in head["blocks"][:index])
    n, length, crc = head["blocks"][index]
    raw = read_range(file, at, 8 * rans.LANES + length)
    return rans.decode([(n, raw[: 8 * rans.LANES], raw[8 * rans.LANES :], crc)], code)


class TokenFiles:
    """A written folder: ``parts`` lists the segment files, ``freq`` is the shared table."""

    def __init__(self, folder: str, parts: DataFrame, freq: np.ndarray):
        self.folder, self.parts, self.freq = folder, parts, freq


def write_tokens(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = END_ID, segment_ids: int = SEGMENT_IDS, remembered: int = CACHE_WORDS
) -> TokenFiles:
    """Encode every whole text, append ``end_id``, and write coded files in ascending order of ids.

    NULL text counts as empty (only the end id).  NULL ids come first; equal ids are ordered by text hash, so
    repeated rows stand side by side.  An empty table writes no file.  Other columns are ignored.  The
    frequency table has at most one entry per id of the vocabulary and covers all documents.  ``remembered``
    words keep their ids in each Python worker, which saves time and changes no result.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "token-files")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("binary").alias("raw"))
    plain = scratch(spark, "token-segments")
    segs = segments(d, tokenizer, end_id, segment_ids, remembered)
    segs.write.option("compression", "zstd").parquet(plain)
    segs = spark.read.schema(segs.schema).parquet(plain)
    counts = id_counts(segs).collect()
    by_id = np.zeros(max([r["id"] for r in counts], default=0) + 1, np.int64)
    for r in counts:
        by_id[r["id"]] = r["n"]
    freq = rans.frequencies(by_id)
    make_folder(folder)
    index = f"{folder}/_parts"
    out = write_files(segs, folder, freq)
    out.write.parquet(index)
    spark.createDataFrame(pd.DataFrame({"id": np.arange(len(freq)), "freq": freq})).coalesce(1).write.parquet(f"{folder}/_table")
    return TokenFiles(folder, spark.read.schema(out.schema).parquet(index), freq)


def read_tokens(files: TokenFiles, doc_type: str = "bigint") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read from the files, one row per written document."""
    freq, spark = files.freq, files.parts.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        code = rans.Table(freq)
        for batch in batches:
            for r in batch.itertuples():
                names, lens, ids = read_file(r.file, code)
                ids = ids.astype("<u4")
                ends = np.cumsum(lens)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lens)]
                yield pd.DataFrame({"name": names, "start": r.base + ends - lens, "n_tokens": lens, "ids_crc32": crcs})

    base = F.sum("n_ids").over(W.orderBy("shard", "seg")) - F.col("n_ids")  # one row per segment file
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = files.parts.withColumn("base", base).repartition(n, "shard", "seg").select("file", "base")
    out = parts.mapInPandas(run, "name string, start long, n_tokens long, ids_crc32 long")
    return out.select(F.col("name").cast(doc_type).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_tokens(write_tokens(docs, default_tokenizer()), docs.schema["doc_id"].dataType.simpleString())
