"""Text, token and sequence functions. Only the Unicode normal forms need Python; the rest is built from Spark functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.sizes import MOST, sized

CJK = r"\p{IsHan}"


#: Texts that Python holds at a time beside their Arrow batch.
TEXTS = 64


def _normal_form(form: str, fold: bool):
    def one(s: str | None) -> str | None:
        out = s if s is None or s.isascii() else unicodedata.normalize(form, s)
        return out.casefold() if fold and out is not None else out

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.chunked_array([pa.array(map(one, b.slice(at, TEXTS).to_pylist()), pa.string()) for at in range(0, len(b), TEXTS)], pa.string()).combine_chunks()

    return F.arrow_udf(apply, "string")


def nfkc(text: Column, fold: bool = False) -> Column:
    """NFKC (and case folding) in Arrow batches; ASCII texts pass through."""
    return _normal_form("NFKC", fold)(text)


def nfc(text: Column) -> Column:
    return _normal_form("NFC", False)(text)


def norm_compact(text: Column) -> Column:
    """NFKC, without white space and punctuation; case stays."""
    return F.regexp_replace(nfkc(text), r"[\s\p{P}]", "")


def norm_reference(text: Column) -> Column:
    """NFKC, case folded, ’ as ', other punctuation as spaces, single spaces, none between two Han characters."""
    t = F.regexp_replace(nfkc(text, fold=True), "’", "'")
    t = F.regexp_replace(t, r"[\p{P}&&[^']]", " ")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.regexp_replace(t, rf"(?<={CJK}) (?={CJK})", "")


def norm_by_language(text: Column, lang: Column) -> Column:
    """English: words with apostrophes; Chinese: the Han characters only."""
    t = F.lower(nfkc(text))
    english = F.array_join(F.regexp_extract_all(F.regexp_replace(t, "’", "'"), F.lit(r"[a-z]+(?:'[a-z]+)*"), F.lit(0)), " ")
    return F.when(lang == "zh", F.regexp_replace(t, rf"[^{CJK}]", "")).otherwise(english)


def norm_request(text: Column, locale: Column) -> Column:
    """T1d: request text by locale; English with other than ASCII characters is null."""
    t = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(~locale.startswith("en"), norm_reference(text)).when(t.rlike(r"^[\x20-\x7E]*$"), t)


def norm_spaces(text: Column) -> Column:
    """T1e: NFC, single spaces."""
    return F.trim(F.regexp_replace(nfc(text), r"\s+", " "))


def norm_folded(text: Column) -> Column:
    """T1f: NFKC, case folded, punctuation as spaces."""
    return F.trim(F.regexp_replace(nfkc(text, fold=True), r"[\s\p{P}]+", " "))


def latin_words(text: Column) -> Column:
    """T1g: runs of a-z."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def alnum_words(text: Column) -> Column:
    """T1g: runs of letters and digits, apostrophes dropped first."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "['’]", ""), F.lit("[a-z0-9]+"), F.lit(0))


def norm_typography(text: Column) -> Column:
    """T1h: white space and punctuation go, full-width forms become plain; characters that sound alike stay apart."""
    return F.regexp_replace(F.lower(nfkc(text)), r"[\s\p{P}\p{S}]", "")


# Marks that phone comparison drops, and rhotic vowels with what they fold to.
PHONE_MARKS = "ˈˌːˑ͡"
RHOTICS = {"ɝ": "ɜ", "ɚ": "ə"}


def norm_phones(tokens: Column) -> Column:
    """Phones without stress, length and tie marks, rhotic vowels folded, joined by spaces."""
    t = F.array_join(tokens, " ")
    t = F.translate(t, "".join(RHOTICS) + PHONE_MARKS, "".join(RHOTICS.values()))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def present(text: Column, keyword: Column) -> Column:
    """Literal presence."""
    return F.contains(text, keyword)


def positions(tokens: Column, needle: list) -> Column:
    """T4: all places of the needle in an array, overlapping ones too; T14 counts them. The array is made once a row, so it is linear."""
    k = len(needle)
    none = F.expr("cast(array() as array<int>)")

    def found(xs: Column) -> Column:
        here = lambda i: reduce(and_, [F.get(xs, i + j).eqNullSafe(F.lit(x)) for j, x in enumerate(needle)])
        return F.when(F.size(xs) < k, none).otherwise(F.filter(F.sequence(F.lit(0), F.size(xs) - k), here))

    return let(tokens, found)


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def escaped(needle: str) -> str:
    return "".join(f"\\Q{c}\\E" for c in needle)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(numbers: Column, chunk: int = 256) -> Column:
    """For each element of an array the sum up to and with it, as longs; by chunks of the array, so that the cost is not square in its size."""
    none = F.expr("cast(array() as array<bigint>)")
    step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"] + x).alias("out"))
    within = lambda xs: F.aggregate(xs, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step)

    def chunked(xs: Column) -> Column:
        firsts = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / chunk).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
        parts = F.transform(firsts, lambda i: within(F.slice(xs, i * chunk + 1, chunk)))
        more = lambda ps: F.zip_with(ps, within(F.transform(ps, lambda p: p["at"]))["out"], lambda p, top: F.transform(p["out"], lambda x: x + top - p["at"]))
        return let(parts, lambda ps: F.flatten(more(ps)))

    return let(numbers, chunked)


def contains_in_order(text: Column, needle: str) -> Column:
    """T5: the characters of the needle in order, with anything between. Each step takes the first place and never goes back, so it is linear."""
    code = [f"\\x{{{ord(c):x}}}" for c in needle]
    return text.rlike("^" + "".join(f"[^{c}]*+{c}" for c in code))


def whole_phrase(text: Column, phrase: str) -> Column:
    """The phrase, with no word character next to either end."""
    return text.rlike(rf"(?<!\w){escaped(phrase)}(?!\w)")


def pattern_matches(clips: DataFrame, patterns: DataFrame, key: str, text: str, full: bool) -> DataFrame:
    """Matches of each clip in a small table (name, pattern): how many, and the name if there is just one."""
    p = F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$")) if full else F.col("pattern")
    hits = clips.select(key, text).join(sized(patterns), F.rlike(F.col(text), p))
    one = hits.groupBy(key).agg(F.count("*").alias("matches"), F.min("name").alias("_name"))
    out = clips.select(key).join(one, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))
    return out.withColumn("only", F.when(F.col("matches") == 1, F.col("_name"))).drop("_name")


#: Edits up to which the diagonals of two sequences are followed, before whole columns are computed.
FEW_EDITS = 32


def edits(a: list, b: list) -> int:
    """Edit distance of two sequences of any tokens. Few edits take time linear in the length; many take bit-parallel columns."""
    n, m, at = len(a), len(b), 0
    while at < min(n, m) and a[at] == b[at]:
        at += 1
    a, b = a[at:], b[at:]
    while a and b and a[-1] == b[-1]:
        a.pop(), b.pop()
    if not a or not b:
        return len(a) + len(b)
    n, m = len(a), len(b)
    furthest = {0: 0}  # diagonal (place in b less place in a) -> places of a matched with as many edits as so far
    for k in range(FEW_EDITS + 1):
        if k:
            low = lambda d: max(furthest.get(d, -2) + 1, furthest.get(d - 1, -2), furthest.get(d + 1, -2) + 1)
            furthest = {d: min(low(d), n, m - d) for d in range(-min(k, n), min(k, m) + 1)}
        for d, i in furthest.items():
            while 0 <= i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            furthest[d] = i
        if furthest.get(m - n) == n:
            return k
    marks: dict = {}
    for i, x in enumerate(a):
        marks.setdefault(x, []).append(i)
    bits = {}
    for x, places in marks.items():
        held = bytearray((n + 7) // 8)
        for i in places:
            held[i >> 3] |= 1 << (i & 7)
        bits[x] = int.from_bytes(held, "little")
    full, last, distance = (1 << n) - 1, 1 << (n - 1), n
    plus, minus = full, 0
    for y in b:
        same = bits.get(y, 0)
        vertical = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up, down = minus | (full & ~(across | plus)), plus & across
        distance += 1 if up & last else -1 if down & last else 0
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return distance


#: Tokens that Python numbers at a time (or those of one row, if it has more).
PIECE = 1_000_000


def _by_pieces(n: np.ndarray, one: Callable[[int, int], pa.Array]) -> pa.Array:
    """one(first row, rows) for pieces of a batch whose rows have n tokens."""
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // PIECE, prepend=-1)) if len(n) else [0]
    return pa.concat_arrays([one(int(i), int(j - i)) for i, j in zip(cuts, [*cuts[1:], len(n)])])


def _lengths(x: pa.Array) -> np.ndarray:
    """How many tokens the rows have: elements of lists, characters of texts; none if null."""
    return pc.fill_null((pc.utf8_length if pa.types.is_string(x.type) else pc.list_value_length)(x), 0).to_numpy().astype(np.int64)


def _distances(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distances of lists of tokens or of texts, row by row. All tokens are numbered at once, and what two rows share at their starts and ends is left out before they become Python lists."""
    n, m = _lengths(a), _lengths(b)
    if pa.types.is_string(a.type):
        x, y = (np.frombuffer("".join(t.fill_null("").to_pylist()).encode("utf-32-le"), np.uint32) for t in (a, b))
    else:
        # A null token has no number of its own: it gets the first one that is free.
        codes = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode()
        code = codes.indices.fill_null(len(codes.dictionary)).to_numpy()
        x, y = code[: n.sum()], code[n.sum() :]
    at, to = np.cumsum(n) - n, np.cumsum(m) - m

    def shared(first: np.ndarray, then: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many tokens of each row agree from its places in x and y on, in this direction."""
        row = np.repeat(np.arange(len(most)), most)
        k = np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most)
        differ = np.flatnonzero(x[first[row] + step * k] != y[then[row] + step * k])
        out = most.copy()
        rows, firsts = np.unique(row[differ], return_index=True)
        out[rows] = k[differ[firsts]]
        return out

    head = shared(at, to, np.minimum(n, m), 1)
    tail = shared(at + n - 1, to + m - 1, np.minimum(n, m) - head, -1)
    i, j, p, q = at + head, at + n - tail, to + head, to + m - tail
    out = np.maximum(j - i, q - p)
    for r in np.flatnonzero((j > i) & (q > p)):
        out[r] = edits(x[i[r] : j[r]].tolist(), y[p[r] : q[r]].tolist())
    null = pc.or_(a.is_null(), b.is_null())
    return pc.if_else(null, None, pa.array(out, pa.int64()))


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two token arrays, of any tokens and any length, or of the characters of two texts; null where one is null."""

    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for xs, ys in batches:
            yield _by_pieces(_lengths(xs) + _lengths(ys), lambda at, rows: _distances(xs.slice(at, rows), ys.slice(at, rows)))

    return F.arrow_udf(apply, "long")(a, b)


def within_one_edit(places: list[str], other: str, size: int) -> str:
    """A pattern for `size` tokens (one more or less than the places, or as many) that are the places but for one edit. places, other: a pattern of one token each."""
    n = len(places)
    if size == n:
        rows = [[*places[:d], other, *places[d + 1 :]] for d in range(n)]
    else:
        rows = [places[:d] + places[d + 1 :] for d in range(n)] if size < n else [[*places[:d], other, *places[d:]] for d in range(n + 1)]
    return "|".join(dict.fromkeys("".join(r) for r in rows))


def windows_at(text: Column, pattern: str, size: int, counted: Callable[[Column], Column] = F.char_length) -> Column:
    """The places where the pattern holds, overlapping ones too, as an array of (at, window): the sum of `counted` over the text before, and the next `size` characters.

    The text is split before each place (a character more in front keeps its head apart), so it is read once, however many characters it has; only places that
    hold become elements. No place is inside a surrogate pair.
    """
    none = F.expr("cast(array() as array<struct<at: bigint, window: string>>)")
    ahead = rf"(?![\uDC00-\uDFFF])(?=(?:{pattern}))"

    def found(pieces: Column) -> Column:
        sums = prefix_sums(F.transform(pieces, counted))
        one = lambda i, to: F.struct((F.get(to, i - 1) - counted(F.lit(" "))).alias("at"), F.substring(F.array_join(F.slice(pieces, i + 1, size), ""), 1, size).alias("window"))
        return F.when(F.size(pieces) < 2, none).otherwise(let(sums, lambda to: F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: one(i, to))))

    return let(F.split(F.concat(F.lit(" "), text), ahead, -1), found)


def near_spans(df: DataFrame, key: str, text: str, target: str, boundary: str = " ") -> DataFrame:
    """Spans of the text within one edit of the target, of its length or one more or less, with no boundary inside.

    A pattern finds the places where one can begin, so only these are looked at character by character.
    """
    n, places = len(target), [f"\\x{{{ord(c):x}}}" for c in target]
    sizes = [k for k in (n - 1, n, n + 1) if k > 0]
    pattern = "|".join(within_one_edit(places, "(?s:.)", k) for k in sizes)

    def spans_of(x: Column) -> Column:
        cut = F.array(*[F.struct(x["at"].cast("int").alias("at"), F.substring(x["window"], 1, k).alias("span"), F.lit(k).alias("size")) for k in sizes])
        whole = F.filter(cut, lambda s: (F.char_length(s["span"]) == s["size"]) & ~F.contains(s["span"], F.lit(boundary)))
        return F.filter(F.transform(whole, lambda s: F.struct(s["at"], s["span"], F.levenshtein(s["span"], F.lit(target)).alias("distance"))), lambda s: s["distance"] <= 1)

    rows = df.where(F.col(text).isNotNull()).select(key, F.explode(windows_at(F.col(text), pattern, n + 1)).alias("_w"))
    return rows.select(key, F.explode(spans_of(F.col("_w"))).alias("_x")).select(key, "_x.at", "_x.span", "_x.distance")


def toneless(reading: Column) -> Column:
    """A numbered reading without its tone."""
    return F.regexp_replace(reading, "[0-9]$", "")


def presence_state(blocked: Column, literal: Column, near: Column, phonetic: Column) -> Column:
    """Blocked is unknown, a literal hit positive, a near or phonetic one unknown, anything else negative."""
    return F.when(blocked, "unknown").when(literal, "positive").when(near | phonetic, "unknown").otherwise("negative")


def ctc_collapse(ids: Column, drop: list[int]) -> Column:
    """Repeats merged, then blank and special ids dropped."""
    merged = F.filter(ids, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(ids, i - 1)))
    return F.filter(merged, lambda x: ~x.isin(*drop)) if drop else merged


def _looked_up(tokens: pa.Array, words: pa.Array, ids: pa.Array) -> pa.Array:
    """For lists of tokens: unsupported, ids and min_frames; null for a list that is empty or null. The tokens of all lists are looked up at once."""
    n = _lengths(tokens)
    at, flat = np.repeat(np.arange(len(n)), n), tokens.flatten()
    found = pc.index_in(flat, value_set=words)
    known = found.is_valid().to_numpy(zero_copy_only=False)
    same = ids.dictionary_encode().indices.to_numpy()[found.to_numpy(zero_copy_only=False)[known].astype(np.int64)]
    code = np.full(len(flat), -1, np.int64)
    code[known] = same
    again = (code[1:] == code[:-1]) & (code[1:] >= 0) & (at[1:] == at[:-1])
    frames = n + np.bincount(at[1:][again], minlength=len(n))
    lacking = ~known & flat.is_valid().to_numpy(zero_copy_only=False)
    kinds = flat.filter(pa.array(lacking)).dictionary_encode()
    order = pc.array_sort_indices(kinds.dictionary).to_numpy()
    size = max(len(order), 1)
    each = np.unique(at[lacking] * size + np.argsort(order)[kinds.indices.to_numpy()])
    listed = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
    unsupported = listed(np.bincount(each // size, minlength=len(n)), kinds.dictionary.take(pa.array(order[each % size])))
    return pa.StructArray.from_arrays([unsupported, listed(n, ids.take(found)), pa.array(frames, pa.int32())], ["unsupported", "ids", "min_frames"], mask=pa.array(n == 0))


def _with_ids(rows: DataFrame, vocabulary: DataFrame, tokens: Column) -> DataFrame:
    """rows with unsupported, ids and min_frames of their tokens. Each task holds the vocabulary (at most MOST tokens) and looks up a batch of rows at a time, so no token leaves its row."""
    held = vocabulary.where("token is not null and id is not null").select("token", "id").toArrow()
    words, ids = (held[c].combine_chunks() for c in ("token", "id"))
    if len(words.unique()) < len(words):
        raise ValueError("a token of the vocabulary has two ids")

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield _by_pieces(_lengths(b), lambda at, rows: _looked_up(b.slice(at, rows), words, ids))

    kind = f"struct<unsupported: array<string>, ids: array<{vocabulary.schema['id'].dataType.simpleString()}>, min_frames: int>"
    return rows.withColumn("_x", F.arrow_udf(apply, kind)(tokens)).select(*rows.columns, "_x.*")


def _joined_ids(rows: DataFrame, vocabulary: DataFrame, key: str, tokens: Column) -> DataFrame:
    """vocabulary_ids with a vocabulary that is too large for each task."""
    long = rows.select(key, F.posexplode(tokens).alias("pos", "token")).join(vocabulary.hint("merge"), "token", "left")
    out = long.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("_x"), F.sort_array(F.collect_set(F.when(F.col("id").isNull(), F.col("token")))).alias("unsupported"))
    out = out.withColumn("ids", F.transform("_x", lambda x: x["id"]))
    repeats = F.size(F.filter("ids", lambda x, i: (i > 0) & (x == F.get(F.col("ids"), i - 1))))
    return out.withColumn("min_frames", F.size("ids") + repeats).drop("_x")


def vocabulary_ids(rows: DataFrame, vocabulary: DataFrame, key: str, tokens: Column) -> DataFrame:
    """Ids of the tokens in order, the tokens that the vocabulary lacks, and the least frames (one more for each repeat). vocabulary: token, id, a row a token."""
    if vocabulary.limit(MOST + 1).count() > MOST:
        return _joined_ids(rows, vocabulary, key, tokens)
    # A filter on the ids would be pushed below them, and all would be looked up twice.
    return _with_ids(rows.where(F.size(tokens) > 0).select(key, tokens.alias("_t")), vocabulary, F.col("_t")).select(key, "unsupported", "ids", "min_frames")


def ctc_targets(rows: DataFrame, vocabulary: DataFrame, key: str, text: str, frames: str, stride: int) -> DataFrame:
    """Target ids of the characters of a text, or why there are none: no_full_transcript, vocabulary_not_supplied, out_of_vocabulary (an id of 0 is the blank,
    so no target), insufficient_frames. An output frame is needed for each id and one more for each repeat. frames: samples of the clip."""
    n = F.col(frames)
    steps = F.expr(f"1 + ({frames} - 400) div 320") if stride == 2 else F.expr(f"(1 + ({frames} - 400) div 160) div {stride}")
    steps = F.when(n < 400, 0).otherwise(F.greatest(steps, F.lit(0)))
    given, held = not vocabulary.isEmpty(), vocabulary.where("id > 0")
    both = rows.select(key, text, steps.cast("long").alias("steps"))
    if held.limit(MOST + 1).count() > MOST:
        ids = _joined_ids(rows.where(F.col(text).isNotNull()), held, key, characters(F.col(text)))
        both = both.join(ids.hint("merge"), key, "left")
    else:
        both = _with_ids(both, held, characters(F.col(text)))
    reason = F.when(F.col(text).isNull(), "no_full_transcript").when(F.lit(not given), "vocabulary_not_supplied").when(F.size("unsupported") > 0, "out_of_vocabulary")
    reason = reason.when(F.col("ids").isNull() | (F.col("steps") < F.col("min_frames")), "insufficient_frames")
    return both.withColumn("reason", reason).select(key, "reason", F.when(F.col("reason").isNull(), F.col("ids")).alias("target_ids"), "min_frames", "steps")


def repetition(text: Column) -> Column:
    """How many characters repeat the one before."""
    return F.regexp_count(text, F.lit(r"(?s)(.)(?=\1)"))


#: Normalisers by policy name; each takes the text column, and the language or locale column where it needs one.
NORMALISERS = {
    "compact": norm_compact,
    "reference": norm_reference,
    "by_language": norm_by_language,
    "request": norm_request,
    "spaces": norm_spaces,
    "folded": norm_folded,
    "typography": norm_typography,
}


def normalised_dimension(rows: DataFrame, text: str, policy: str, *more: str) -> DataFrame:
    """Each distinct text once with its normal form, to be stored and joined: the Unicode work is done once a text."""
    keys = [text, *more]
    return rows.select(*keys).where(F.col(text).isNotNull()).distinct().withColumn("norm_text", NORMALISERS[policy](*[F.col(k) for k in keys]))
