"""Tokens that read like a target, and the evidence a text gives for it.

A token's match with a target of n tokens is a whole number: bit j is set if it may be the j-th one. A span within one edit has all but one of its
tokens on three diagonals, so each matching token names the few spans it can belong to, and spans are found by grouping on them: no window over a
text, no pairs. Of a span, `fwd` holds the tokens that match counted from the start, `bwd` those counted from the end; their first runs L and R
tell whether one edit is enough. The evidence of whole texts is found by patterns over codes of their characters, inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Tokens that part words: white space and punctuation, as a character class.
BOUNDARY = r"\s\p{P}"


def _bit(mask: Column, j: Column) -> Column:
    return F.call_function("shiftright", mask, j.cast("int")).bitwiseAND(F.lit(1).cast("long"))


def _set(j: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), j.cast("int"))


def _run(bits: Column) -> Column:
    """How many of the lowest bits are set without a gap."""
    return F.bit_count(bits.bitwiseXOR(bits + 1)) - 1


def reading_mask(readings: Column, target: list[list[str]], tones: bool) -> Column:
    """Bit j: a reading of the token is one of the j-th target token; all bits without a reading."""
    plain = readings if tones else F.transform(readings, T.toneless)
    out = F.lit(0).cast("long")
    for j, rs in enumerate(target):
        want = F.array(*[F.lit(r if tones else r.rstrip("0123456789")) for r in rs])
        out = out + F.when(F.arrays_overlap(plain, want), 1 << j).otherwise(0)
    return F.when(F.coalesce(F.size(readings), F.lit(0)) < 1, (1 << len(target)) - 1).otherwise(out).cast("long")


def _shapes(mask: Column, n: int, edits: bool) -> Column:
    """The spans that a token with this match can belong to: its place i in the span, the span's size, its bits; edits: of n - 1 and n + 1 tokens too."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: _bit(mask, j) == 1)
    shape = lambda i, size: F.struct(i.alias("i"), F.lit(size).alias("size"))
    more = lambda j: [shape(j, n + 1), shape(j + 1, n + 1), shape(j, n - 1), shape(j - 1, n - 1)] if edits else []
    named = F.filter(F.array_distinct(F.flatten(F.transform(bits, lambda j: F.array(shape(j, n), *more(j))))), lambda s: (s["i"] >= 0) & (s["i"] < s["size"]))
    inside = lambda j: F.least(F.greatest(j, F.lit(0)), F.lit(n - 1))
    one = lambda i, j: F.when((i < n) & (_bit(mask, inside(j)) == 1), _set(i)).otherwise(0).cast("long")
    last = lambda s: s["size"] - 1 - s["i"]
    return F.transform(named, lambda s: F.struct(s["i"], s["size"], one(s["i"], s["i"]).alias("fwd"), one(last(s), n - 1 - last(s)).alias("bwd")))


def _one_edit(n: int) -> Column:
    return _run(F.col("fwd")) + _run(F.col("bwd")) >= F.col("size") - F.when(F.col("size") >= n, 1).otherwise(0)


def _distance(n: int) -> Column:
    return F.when((F.col("size") == n) & (_run(F.col("fwd")) == n), 0).otherwise(1)


def _long_enough(n: int) -> None:
    if not 2 <= n <= 60:
        raise ValueError("a target has 2 to 60 tokens")


def phonetic_spans(tokens: DataFrame, key: str, target: list[list[str]], tones: bool = True) -> DataFrame:
    """Spans of consecutive tokens (pos from 0, readings; see lexicon_lookup) within one edit of the target's readings.

    Spans have the target's length, or one more or less. A token without a reading may be any of them. If tokens have a column `of`, how many their key has,
    only those that match are shuffled.
    """
    n = len(target)
    _long_enough(n)
    known = "of" in tokens.columns
    hits = tokens.select(key, "pos", *(["of"] if known else []), reading_mask(F.col("readings"), target, tones).alias("mask")).where("mask <> 0")
    if not known:
        hits = hits.join(tokens.groupBy(key).agg((F.max("pos") + 1).alias("of")).hint("merge"), key)
    rows = hits.select(key, "pos", "of", F.explode(_shapes(F.col("mask"), n, True)).alias("s"))
    rows = rows.select(key, (F.col("pos") - F.col("s.i")).alias("start"), "of", "s.size", "s.fwd", "s.bwd").where("start >= 0 and start + size <= of")
    spans = rows.groupBy(key, "start", "size").agg(F.bit_or("fwd").alias("fwd"), F.bit_or("bwd").alias("bwd")).where(_one_edit(n))
    return spans.select(key, F.col("start").cast("int").alias("from"), "size", _distance(n).alias("distance"))


#: Characters that stand for classes of tokens; none is a boundary.
CODES = [c for c in map(chr, range(0x30, 0xD800)) if c.isalnum()]


class _Coded:
    """Texts as strings of codes, one a character: tokens of the lexicon that match the same places of the target share a code, all others (which may be any token:
    wild) have the first one, boundaries are spaces. So patterns over a text find its spans, and no character leaves its row.

    The lexicon's single characters come to the driver; there are no more of them than Unicode has.
    """

    def __init__(self, lexicon: DataFrame, target: str):
        _long_enough(len(target))
        known = lexicon.where((F.size("readings") > 0) & (F.char_length("token") == 1))
        held = {r.token: list(r.readings) for r in known.where(F.col("token").isin(list(target))).select("token", "readings").collect()}
        readings = [held.get(c, []) for c in target]
        if not all(readings):
            raise ValueError("each token of the target needs a reading")
        masks = [reading_mask(F.col("readings"), readings, tones) for tones in (True, False)]
        rows = known.where(~F.rlike("token", F.lit(f"[{BOUNDARY}]"))).select("token", *masks, F.size("readings") > 1).collect()
        kind = lambda token, toned, plain, several: (sum(1 << j for j, c in enumerate(target) if c == token), toned, plain, several)
        kinds = {token: kind(token, *rest) for token, *rest in rows}
        if len(kinds) < len(rows):
            raise ValueError("a token has several rows in the lexicon")
        self.n, self.target = len(target), target
        self.oov, *codes = CODES[: len(set(kinds.values())) + 1]
        self.code = dict(zip(sorted(set(kinds.values())), codes))
        self.map = {c: self.oov for c in (self.oov, *codes)} | {token: self.code[k] for token, k in kinds.items()}
        self.lexical = self.any_of(lambda *k: True)
        self.several = "".join(c for k, c in self.code.items() if k[3])

    def any_of(self, wanted, wild: bool = False) -> str:
        """A pattern of one token: those of the lexicon with same, toned, plain and several as wanted; wild: those out of it too."""
        held = "".join(c for k, c in self.code.items() if wanted(*k)) + (self.oov if wild else "")
        return f"[{held}]" if held else "(?!)"

    def text(self, text: Column) -> Column:
        held = F.regexp_replace(F.translate(text, "".join(self.map), "".join(self.map.values())), f"[{BOUNDARY}]", " ")
        return F.regexp_replace(held, f"[^ {self.oov}{''.join(self.code.values())}]", self.oov)

    def places(self, kind: str) -> list[str]:
        """For each place of the target a pattern of the tokens that match it."""
        if kind == "text":
            return [self.any_of(lambda same, toned, plain, several, j=j: same >> j & 1) for j in range(self.n)]
        return [self.any_of(lambda same, toned, plain, several, j=j: plain >> j & 1, kind == "local") for j in range(self.n)]

    def toned(self) -> str:
        return "".join(self.any_of(lambda same, toned, plain, several, j=j: toned >> j & 1) for j in range(self.n))

    def spans(self, kind: str) -> dict[int, str]:
        """The sizes of the spans of a kind, and a pattern of each; those of kind local are looked for where the boundaries have been left out."""
        p = self.places(kind)
        if kind == "dictionary":
            return {self.n: self.toned() + "|" + T.within_one_edit(p, self.lexical, self.n)}
        out = {k: T.within_one_edit(p, "[^ ]", k) for k in (self.n - 1, self.n, self.n + 1)}
        if kind == "text":
            out[self.n] = f"(?!{''.join(p)})(?:{out[self.n]})"
        return out

    def matching_several(self, kind: str, size: int, i: int) -> str:
        """A pattern of the tokens with several readings that match the target at place i of a span of this size, or one edit from it."""
        bits = sum(1 << j for j in ({i} if size == self.n else {i, i - 1} if size > self.n else {i, i + 1}) if 0 <= j < self.n)
        return self.any_of(lambda same, toned, plain, several: several and (same if kind == "text" else plain) & bits)


def _ahead(pattern: str) -> Column:
    return F.lit(f"(?=(?:{pattern}))")


def evidence_spans(clips: DataFrame, lexicon: DataFrame, keys: list[str], text: str, target: str) -> DataFrame:
    """The spans of a text that may be the target, by kind:

    * `text`: within one edit of its characters, no boundary inside, not the target itself;
    * `dictionary`: as many tokens, all in the lexicon, no boundary inside, whose readings meet with tones (distance 0), or without tones at all places but one;
    * `local`: within one edit without tones; boundaries are skipped and a token out of vocabulary may be any.

    start, size and the positions (of tokens out of vocabulary, of matching ones with several readings) count the tokens that are no boundary. lexicon: token, readings, a row a token. A null text has none.
    """
    c = _Coded(lexicon, target)
    own = lambda s: F.char_length(F.translate(s, " ", ""))

    def found(kind: str, size: int, pattern: str) -> Column:
        def one(x: Column) -> Column:
            at = lambda i: F.substring(x["window"], i + 1, 1)
            places = lambda fits: F.array_compact(F.array(*[F.when(fits(i), x["at"] + i) for i in range(size)]))
            exact = F.rlike(x["window"], F.lit(c.toned()))
            same = F.rlike(x["window"], F.lit("".join(c.places(kind)))) & F.lit(size == c.n)
            distance = F.when(exact | same, 0).otherwise(1) if kind == "dictionary" else F.when(same, 0).otherwise(1)
            oov = places(lambda i: at(i) == c.oov) if kind == "local" else F.expr("cast(array() as array<bigint>)")
            several = places(lambda i: F.rlike(at(i), F.lit(c.matching_several(kind, size, i))))
            tones = exact if kind == "dictionary" else F.lit(None).cast("boolean")
            return F.struct(F.lit(kind).alias("kind"), x["at"].alias("start"), F.lit(size).alias("size"), distance.alias("distance"), tones.alias("tones_meet"), oov.alias("oov_positions"), several.alias("ambiguous_positions"))

        held = F.translate("_coded", " ", "") if kind == "local" else F.col("_coded")
        return F.transform(T.windows_at(held, pattern, size, own), one)

    rows = clips.where(F.col(text).isNotNull()).select(*keys, c.text(F.col(text)).alias("_coded"))
    spans = F.concat(*[found(kind, size, p) for kind in ("text", "dictionary", "local") for size, p in c.spans(kind).items()])
    return rows.select(*keys, F.explode(spans).alias("_s")).select(*keys, "_s.*")


def _apart(text: Column, target: str) -> Column:
    return ~F.contains(text, F.lit(target)) & F.contains(F.regexp_replace(text, f"[{BOUNDARY}]+", ""), F.lit(target))


def target_doubt(rows: DataFrame, lexicon: DataFrame, text: str, target: str, name: str) -> DataFrame:
    """Rows with the column `name`: whether a text gives evidence short of the target itself (see the blockers of target_evidence). It looks no further than the first evidence; null for a null text."""
    c = _Coded(lexicon, target)
    held = rows.withColumn("_coded", c.text(F.col(text))).withColumn("_plain", F.translate("_coded", " ", ""))
    short = F.rlike("_plain", F.lit(f"^{c.oov}+$"))
    near = lambda kind: F.rlike("_plain" if kind == "local" else "_coded", F.lit("|".join(f"(?:{p})" for p in c.spans(kind).values())))
    doubt = F.when(near("local"), True).when(near("dictionary"), True).when(near("text"), True).when(short, True).otherwise(_apart(F.col(text), target))
    return held.withColumn(name, F.when(F.col(text).isNotNull(), doubt)).drop("_coded", "_plain")


def target_evidence(clips: DataFrame, lexicon: DataFrame, keys: list[str], text: str, target: str) -> DataFrame:
    """One row a clip: how many spans of each kind (see evidence_spans), whether the target is there, or there once boundaries are left out, what the lexicon lacks, and the state.

    blockers: insufficient_lexical_evidence (nothing in the lexicon, something out of it), confusable_or_partial_target. A literal target
    is positive, a blocked text unknown, anything else negative; a null text is unknown. Patterns count the spans; nothing is shuffled.
    """
    c, t = _Coded(lexicon, target), F.col(text)
    rows = clips.select(*keys, text, c.text(t).alias("_coded")).withColumn("_plain", F.translate("_coded", " ", ""))
    count = lambda of, *patterns: sum((F.regexp_count(of, _ahead(p)) for p in patterns), F.lit(0))
    with_oov = lambda size, p: f"(?=[^{c.oov}]{{0,{size - 1}}}{c.oov})(?:{p})"
    local = c.spans("local")
    oov = F.char_length("_plain") - F.char_length(F.translate("_plain", c.oov, ""))
    counts = {
        "near_text": count("_coded", *c.spans("text").values()),
        "dictionary": count("_coded", *c.spans("dictionary").values()),
        "toned": count("_coded", c.toned()),
        "local": count("_plain", *local.values()),
        "local_oov": F.when(oov > 0, count("_plain", *[with_oov(k, p) for k, p in local.items()])),
        "oov": oov,
        "lexical": F.char_length("_plain") - oov,
        "ambiguous": F.char_length("_plain") - F.char_length(F.translate("_plain", c.several, "")) if c.several else F.lit(0),
    }
    counted = {k: F.coalesce(F.when(t.isNotNull(), v), F.lit(0)).cast("long") for k, v in counts.items()}
    out = rows.select(*keys, t.isNull().alias("_none"), F.contains(t, F.lit(target)).alias("literal"), _apart(t, target).alias("boundary_separated"), *[v.alias(k) for k, v in counted.items()])
    short = (F.col("oov") > 0) & (F.col("lexical") == 0)
    near = (F.col("near_text") > 0) | (F.col("dictionary") > 0) | (F.col("local") > 0) | F.col("boundary_separated")
    blockers = F.filter(F.array(F.when(short, "insufficient_lexical_evidence"), F.when(near, "confusable_or_partial_target")), lambda b: b.isNotNull())
    state = T.presence_state(F.col("_none"), F.col("literal"), short, near)
    return out.select(*keys, "literal", "boundary_separated", *counts, blockers.alias("blockers"), state.alias("state"))
