"""Fill-in-middle transformation: a text is cut twice at unit boundaries and its parts are reordered around sentinels.

Every byte of a text gets a character class: first letter of a run, further letter, other ASCII character, first byte of a
wider character, further byte. A wavelet matrix over the classes answers how many bytes of a class lie before a position
(rank) with one look-up a level. A unit begins at every byte of some classes, so the sum of their ranks counts the units
before a position, another sum counts the characters, and the place of a cut after k units is found by bisection on these
counts. One matrix holds the texts of a slice of rows end to end, and all their cuts are looked up at once.

Cases: a null text is an empty one; empty texts, texts that contain a sentinel and a share of the others (by hash of the id)
stay plain; a null id hashes as an empty one; equal ids get equal draws, so repeated rows with equal texts are cut alike;
bytes that are no valid UTF-8 pass through as they are (a stray further byte belongs to the character before it); a slice
holds the bytes of one very long text or up to SLICE_BYTES of shorter ones; an empty table stays empty; columns of the input that
are named like an added one are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specgrid.llm.common import table, utf8

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that stay plain, and of the others that put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes of text in one wavelet matrix, unless a single text is longer.
SLICE_BYTES = 4 << 20

LETTER, LETTER_MORE, SIGN, WIDE, WIDE_MORE = range(5)
LEVELS = 3
KIND = np.array([WIDE_MORE if 128 <= b < 192 else WIDE if b >= 192 else LETTER if chr(b).isalpha() else SIGN for b in range(256)], np.uint8)
#: Classes whose bytes begin a unit: runs of letters and single other characters, or every character.
UNITS = {"token": (LETTER, SIGN, WIDE), "char": (LETTER, LETTER_MORE, SIGN, WIDE)}


class Bits:
    """A row of bits in words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed[: -(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)


class WaveletMatrix:
    """Ranks of small symbols: level by level from the highest bit, the symbols are dealt into those with a 0, then those with a 1."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.rows = []
        for level in reversed(range(levels)):
            bit = (symbols >> level & 1).astype(bool)
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
            self.rows.append((level, Bits(bit), len(bit) - int(bit.sum())))

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol occurs among the first `at` symbols."""
        first = np.zeros(1, np.int64)
        for level, bits, zeros in self.rows:
            if symbol >> level & 1:
                first, at = zeros + bits.ones(first), zeros + bits.ones(at)
            else:
                first, at = first - bits.ones(first), at - bits.ones(at)
        return at - first

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, at) for s in symbols)


def classes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of every byte; a run of letters begins anew at each start."""
    kinds = KIND[raw]
    letter = kinds == LETTER
    kinds[1:][letter[1:] & letter[:-1]] = LETTER_MORE
    first = starts[starts < len(raw)]
    kinds[first[letter[first]]] = LETTER
    return kinds


class Cutter:
    """Units, characters and cuts of texts that lie end to end: text i is raw[edges[i]:edges[i + 1]]."""

    def __init__(self, raw: np.ndarray, edges: np.ndarray, unit: str = "token"):
        self.starts, self.ends = edges[:-1], edges[1:]
        self.matrix, self.unit = WaveletMatrix(classes(raw, self.starts)), UNITS[unit]
        self.before = self.matrix.count(self.unit, self.starts)
        self.n = self.matrix.count(self.unit, self.ends) - self.before

    def after(self, k: np.ndarray) -> np.ndarray:
        """Where each text's first k units end: the last position with no more than k units before it."""
        low, high, most = self.starts, self.ends, k + self.before
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.matrix.count(self.unit, middle) <= most
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low

    def chars(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.matrix.count(UNITS["char"], end) - self.matrix.count(UNITS["char"], start)


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of rows with up to `most` bytes of text, or of one row."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def formatted(texts: list[bytes], draws: list[np.ndarray], plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, unit: str = "token") -> dict[str, list]:
    """n, form, prefix_chars, middle_chars and output of every text, from four whole numbers each."""
    edges = np.concatenate(([0], np.cumsum([len(x) for x in texts], dtype=np.int64)))
    cut = Cutter(np.frombuffer(b"".join(texts), np.uint8), edges, unit)
    first, second = draws[0] % (cut.n + 1), draws[1] % (cut.n + 1)
    a, b = cut.after(np.minimum(first, second)), cut.after(np.maximum(first, second))
    prefix, middle = cut.chars(cut.starts, a), cut.chars(a, b)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    out = {"n": cut.n.tolist(), "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
    stays, turns = draws[2] % 100 >= 100 - plain, draws[3] % 100 < suffix_first
    for i, (text, at, to) in enumerate(zip(texts, (a - cut.starts).tolist(), (b - cut.starts).tolist(), strict=True)):
        whole = not text or bool(stays[i]) or p in text or s in text or m in text
        form = "plain" if whole else "spm" if turns[i] else "psm"
        if form == "plain":
            made = text
        elif form == "psm":
            made = b"".join((p, text[:at], s, text[to:], m, text[at:to]))
        else:
            made = b"".join((s, text[to:], p, text[:at], m, text[at:to]))
        out["form"].append(form)
        out["prefix_chars"].append(None if whole else int(prefix[i]))
        out["middle_chars"].append(None if whole else int(middle[i]))
        out["output"].append(made)
    return out


def draws(doc_id: str = "doc_id", seed: str = "1") -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of seed, colon and id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


ADDED = "n long, form string, prefix_chars long, middle_chars long, output binary"


def fill_in_middle(docs: DataFrame, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, unit: str = "token", seed: str = "1") -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, the text to train on."""
    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    own = [c for c in docs.columns if c not in added]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def cut(batches):
        for batch in slices(batches, 1):
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            hashes = [batch.column(2 + i).to_numpy() for i in range(4)]
            got = formatted(texts, hashes, plain, suffix_first, unit)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[c], kind) for c, kind in zip(added, kinds, strict=True))], ["row", *added])

    wide = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), utf8().alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(draws(seed=seed))))
    got = wide.mapInArrow(cut, T.StructType([wide.schema["row"], *T.StructType.fromDDL(ADDED)]))
    return got.select("row.*", *added[:-1], F.col("output").cast("string").alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of. The sentinels stand in it once each, since a text that holds one stays plain."""
    out, before, after = F.col(output), lambda x, mark: F.substring_index(x, mark, 1), lambda x, mark: F.substring_index(x, mark, -1)
    psm = F.concat(after(before(out, SUFFIX), PREFIX), after(out, MIDDLE), before(after(out, SUFFIX), MIDDLE))
    spm = F.concat(before(after(out, PREFIX), MIDDLE), after(out, MIDDLE), after(before(out, PREFIX), SUFFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def op11_wavelet_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every document is cut, with the digests of its output and of the text rebuilt from it."""
    got = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


OP11_SQL = """
with hashed as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
drawn as (
  select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units,
    cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
    cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4
  from hashed),
cut as (
  select *, cast(len(units) as bigint) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from drawn),
parts as (
  select doc_id, text, n, form, array_to_string(units[1:a], '') as p, array_to_string(units[a + 1:b], '') as m, array_to_string(units[b + 1:n], '') as s
  from cut)
select doc_id, n, form,
  case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""
