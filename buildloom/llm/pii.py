"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Base spans (email, ip, card, phone) are found by their formats and checks and always stay.
Generators of high recall propose further spans that may overlap (short and long card numbers,
written-out mail addresses, IPv6, national phone numbers, numbers run together); each has format
and context features, all small whole numbers, and a check of its own that no feature shows:
Luhn's sum, octets or hextets, a top-level domain, groups as phone numbers have them.  The trees
are boosted on whether candidates of such features pass their check, from counts of (features,
passes) over all candidates of all documents: there are at most `CELLS` different rows of
features, so the fit's input is bounded by them and not by the corpus.

Other numbers pass a check by chance, in a share `CHANCE` of them.  So if candidates of some
features pass in a share r, a part (r - chance) / (1 - chance) of them is real, and one that passes
is real in that part over r.  Thresholds for each kind are calibrated on the documents held out by
crc32(id) mod 5 = 0; a kind with few candidates there leans on all kinds together.  What passes,
reaches its threshold and overlaps nothing better is added.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, written

KINDS = ("email", "ip", "card", "phone")

# The formats.  Possessive repeats and look-behinds keep them linear; matches are the same.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?@\x20?|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00)?[(]?[0-9][0-9().\x20/-]{5,18}[0-9](?![0-9A-Za-z])",
}
CUES = {
    "email": r"(?i)e-?mail|contact|write|address",
    "ip": r"(?i)\bip\b|host|server|addr",
    "card": r"(?i)card|visa|master|amex|credit|pay",
    "phone": r"(?i)phone|tel|call|mobile|fax|cell",
}
#: kind, digits, groups, left, right, cue: how many values each feature has
FEATURES = {"kind": 4, "digits": 7, "groups": 4, "left": 3, "right": 3, "cue": 2}
CELLS = int(np.prod(list(FEATURES.values())))
#: the share of other signs that pass a kind's check: Luhn's sum is right one time in ten, the rest are set by hand
CHANCE = {"email": 0.3, "ip": 0.3, "card": 0.1, "phone": 0.3}
ROUNDS, RATE, LEAST_PRECISION = 40, 0.3, 0.85
#: candidates of all kinds together that a kind's own held-out ones are weighed against
PRIOR = 20.0


def _likely(kind: str, text: Column) -> Column:
    """A cheap test that any match of the kind needs."""
    if kind == "email":
        return text.contains("@") | text.rlike(r"[\[(]at[\])]")
    return text.rlike("[0-9]") if kind != "phone" else text.rlike(r"[0-9][0-9().\x20/+-]{5}")


#: matches whose lengths are summed up as one
BLOCK = 256


def matches(text: Column, pattern: str, likely: Column, good=None) -> Column:
    """array<struct<start, end, match, before, after>> of a pattern's leftmost matches for which good(match) holds, in code points.

    The pieces between matches give the places: a match starts where the pieces and matches before it
    end.  These lengths are summed by blocks of `BLOCK` matches and then within a block, for the good
    ones alone, so a text of very many matches takes time in proportion to them."""
    kind = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
    none = F.array().cast(kind)
    once = lambda value, then: F.flatten(F.transform(F.array(value), then))  # noqa: E731  binds a value, so that it is made once
    add = lambda steps: F.aggregate(steps, F.lit(0), lambda t, x: t + x)

    def zipped(p: Column) -> Column:
        piece = lambda i: F.get(p["g"], i)
        return F.transform(p["m"], lambda m, i: F.struct(i.alias("i"), m.alias("m"), F.char_length(piece(i)).alias("skip"), F.char_length(m).alias("long"), F.right(piece(i), F.lit(24)).alias("before"), F.left(piece(i + 1), F.lit(1)).alias("after")))

    def placed(w: Column) -> Column:
        def one(x: Column) -> Column:
            block = F.floor(x["i"] / BLOCK).cast("int")
            start = F.get(w["sums"], block) + add(F.slice(w["steps"], block * BLOCK + 1, x["i"] % BLOCK)) + x["skip"]
            return F.struct(start.alias("start"), (start + x["long"]).alias("end"), x["m"].alias("match"), x["before"].alias("before"), x["after"].alias("after"))

        return F.transform(w["kept"], one).cast(kind)

    def summed(w: Column) -> Column:
        last = F.size(w["blocks"])
        sums = F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda b: add(F.slice(w["blocks"], F.lit(1), b)))
        return once(F.struct(w["kept"].alias("kept"), w["steps"].alias("steps"), sums.alias("sums")), placed)

    def stepped(z: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(z["all"]) / BLOCK).cast("int")), lambda b: add(F.slice(z["steps"], b * BLOCK + 1, F.lit(BLOCK))))
        kept = F.filter(z["all"], lambda x: good(x["m"])) if good else z["all"]
        return once(F.struct(kept.alias("kept"), z["steps"].alias("steps"), blocks.alias("blocks")), summed)

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    every = once(found, lambda p: F.array(F.struct(zipped(p).alias("all"))))
    out = F.flatten(F.transform(every, lambda z: once(F.struct(z["all"].alias("all"), F.transform(z["all"], lambda x: x["skip"] + x["long"]).alias("steps")), stepped)))
    return F.when(likely, out).otherwise(none)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum ends in 0."""

    def add(total, c, i):
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    pairs = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(F.filter(pairs, lambda p: p["c"] != ""), F.lit(0), lambda t, p: add(t, p["c"], p["i"])) % 10 == 0


_OCTETS = r"^(?:\x20?0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])\x20?(?:\.|$)){4}$"


def _passes(kind: str, m: Column) -> Column:
    """The base check of a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(_OCTETS)
    n = F.char_length(_digits(m))
    return n.between(16, 19) & luhn(_digits(m)) if kind == "card" else n.between(8, 15)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>>, kind 0 to 3 as in KINDS, sorted."""

    def of(i: int, k: str) -> Column:
        good = matches(text, BASE[k], _likely(k, text), lambda m: _passes(k, m))
        return F.transform(good, lambda x: F.struct(F.lit(i).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return F.array_sort(F.concat(*(of(i, k) for i, k in enumerate(KINDS))))


def _side(c: Column) -> Column:
    """0: nothing or white space, 1: other signs, 2: a letter or digit."""
    return F.when((c == "") | c.isNull() | c.rlike(r"^\s$"), 0).when(c.rlike(r"^[\p{L}\p{N}]$"), 2).otherwise(1)


def candidates(text: Column) -> Column:
    """array<struct<start, end, kind, valid, digits, groups, left, right, cue>> of all generators; spans may overlap.  valid tells if the kind's check is passed and is no feature."""

    def of(i: int, k: str) -> Column:
        def item(x):
            m = x["match"]
            n = F.char_length(_digits(m))
            valid = {
                "email": m.rlike(r"^[A-Za-z0-9].*(?:\.|dot[\])]\x20?)[A-Za-z]{2,}$"),
                "ip": m.rlike(_OCTETS) | m.rlike(r"^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}$"),
                "card": n.between(13, 19) & luhn(_digits(m)),
                "phone": n.between(8, 15) & m.rlike(r"^(?:\+|00)?[0-9]{0,3}\x20?[(]?[0-9]{2,4}[)]?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,4}$"),
            }[k]
            bins = F.when(n < 7, 0).when(n == 7, 1).when(n < 10, 2).when(n < 13, 3).when(n < 16, 4).when(n < 20, 5).otherwise(6)
            groups = F.when(m.contains("("), 2).when(m.rlike(r"^[^\x20./:-]*$"), 0).when(m.rlike(r"\x20[^-./]*[./-]|[./-][^\x20]*\x20"), 3).otherwise(1)
            return F.struct(
                x["start"].alias("start"), x["end"].alias("end"), F.lit(i).alias("kind"), F.coalesce(valid, F.lit(False)).cast("int").alias("valid"), bins.alias("digits"), groups.alias("groups"),
                _side(F.right(x["before"], F.lit(1))).alias("left"), _side(x["after"]).alias("right"), x["before"].rlike(CUES[k]).cast("int").alias("cue"),
            )

        return F.transform(matches(text, LOOSE[k], _likely(k, text)), item)

    return F.concat(*(of(i, k) for i, k in enumerate(KINDS)))


class Boosted:
    """Depth-two trees on tests `feature = value`, boosted on the logistic loss of counted rows."""

    def __init__(self, rows: list[dict], rounds: int = ROUNDS, rate: float = RATE):
        names = list(FEATURES)
        self.tests = [(f, v) for f in names for v in range(FEATURES[f])]
        x = np.array([[r[f] == v for f, v in self.tests] for r in rows], bool).reshape(len(rows), len(self.tests))
        n = np.array([r["n"] for r in rows], float)
        y = np.array([r["y"] for r in rows], float)
        self.bias, self.trees = (float(np.log((y.sum() + 0.5) / (n.sum() - y.sum() + 0.5))) if len(rows) else -5.0), []
        z = np.full(len(rows), self.bias)
        for _ in range(rounds if len(rows) else 0):
            p = 1 / (1 + np.exp(-z))
            g, h = y - n * p, n * p * (1 - p)

            def best(inside):
                def worth(m):
                    return (g @ m) ** 2 / (h @ m + 1.0)

                yes, no = x & inside[:, None], ~x & inside[:, None]
                gain = worth(yes) + worth(no)
                return int(np.argmax(gain)), rate * (g @ yes) / (h @ yes + 1.0), rate * (g @ no) / (h @ no + 1.0)

            root, _, _ = best(np.ones(len(rows), bool))
            tree = [root]
            for inside in (x[:, root], ~x[:, root]):
                t, yes, no = best(inside)
                tree.append((t, float(yes[t]), float(no[t])))
                z += np.where(inside, np.where(x[:, t], yes[t], no[t]), 0.0)
            self.trees.append(tree)
        self.scores = 1 / (1 + np.exp(-z))

    def expression(self, c: Column) -> Column:
        """The probability as an expression over a candidate's features."""
        test = lambda t: c[self.tests[t][0]] == self.tests[t][1]
        z = F.lit(self.bias)
        for root, (a, ay, an), (b, by, bn) in self.trees:
            z = z + F.when(test(root), F.when(test(a), ay).otherwise(an)).otherwise(F.when(test(b), by).otherwise(bn))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def precision(passed, chance):
    """The share of real ones among those that pass, where a share `passed` of all pass and `chance` of the others do."""
    return (passed - chance) / ((1 - chance) * passed)


def thresholds(rows: list[dict], scores: np.ndarray, least: float = LEAST_PRECISION) -> list[float]:
    """For each kind the least score from which on held-out candidates that pass their check are real in a share of `least`; 2 (none) where no score will do.

    The share that passes is read off the held-out rows of the kind, with `PRIOR` more of all kinds
    together, and with the model's own scores where there are none at all: no number switches a kind off."""
    n, y = np.array([r["n_held"] for r in rows], float), np.array([r["y_held"] for r in rows], float)
    kind, out = np.array([r["kind"] for r in rows], int), []
    for k, name in enumerate(KINDS):
        found = 2.0
        for s in np.unique(scores[kind == k]):
            above = scores >= s
            mine = above & (kind == k)
            pool = (y[above].sum() + s) / (n[above].sum() + 1.0)
            share = (y[mine].sum() + PRIOR * pool) / (n[mine].sum() + PRIOR)
            if precision(max(share, 1e-9), CHANCE[name]) >= least:
                found = float(s) - 1e-9
                break
        out.append(found)
    return out


_SPANS = "array<struct<kind:int,start:int,end:int,score:double>>"


def _meets(b: Column, c: Column) -> Column:
    return (b["start"] < c["end"]) & (c["start"] < b["end"])


def fitted(found: DataFrame) -> tuple[Boosted, list[float]]:
    """The trees and thresholds for found(held, found), found as candidates() gives it."""
    cells = found.select("held", F.explode("found").alias("c")).groupBy(*(F.col(f"c.{f}").alias(f) for f in FEATURES)).agg(
        F.count_if(~F.col("held")).alias("n"), F.sum(F.when(~F.col("held"), F.col("c.valid")).otherwise(0)).alias("y"), F.count_if("held").alias("n_held"), F.sum(F.when(F.col("held"), F.col("c.valid")).otherwise(0)).alias("y_held"),
    )
    seen = sorted((r.asDict() for r in cells.collect()), key=lambda r: [r[f] for f in FEATURES])  # CELLS rows at most
    model = Boosted(seen)
    return model, thresholds(seen, model.scores)


def added_spans(base: Column, found: Column, model: Boosted, least: list[float]) -> Column:
    """array<struct<kind, start, end, score>>: the candidates that pass their check and reach their threshold, best first where they overlap; none overlaps a base span."""
    limit = lambda c: F.element_at(F.array(*(F.lit(x) for x in least)), c["kind"] + 1)
    fresh = F.filter(found, lambda c: (c["valid"] == 1) & ~F.exists(base, lambda b: _meets(b, c)))
    scored = F.transform(fresh, lambda c: F.struct((-model.expression(c)).alias("low"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    scored = F.array_sort(F.filter(scored, lambda c: -c["low"] >= limit(c)))

    def take(done, c):
        item = F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), (-c["low"]).alias("score"))
        return F.when(F.exists(done, lambda b: _meets(b, c)), done).otherwise(F.concat(done, F.array(item)).cast(_SPANS))

    out = F.array_sort(F.aggregate(scored, F.array().cast(_SPANS), take))
    return F.when(F.exists(found, lambda c: c["valid"] == 1), out).otherwise(F.array().cast(_SPANS))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added) of each row of docs: arrays of (kind, start, end), kinds 0 to 3 as in KINDS, code points, end exclusive.

    added holds what the boosted trees select beyond the base spans, score included; nothing in it
    overlaps a base span or anything else in it, and of overlapping candidates the better score, then
    the earlier start counts.  Null texts count as empty and have no spans.  Repeated rows and null
    ids stay (a null id is not held out); an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held_out(id_col, 0).alias("held"))
    rows = written(rows.select("id", "held", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("found")), "spans")
    return rows.select(F.col("id").alias(id_col), "base", added_spans(F.col("base"), F.col("found"), *fitted(rows)).alias("added"))


def _listed(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans, their digest, and all spans as one string."""
    of = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    count = [of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    every = F.array_sort(F.concat("base", F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))))
    return found.select(id_col, *count, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(every).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """text with each span (kind, start, end) replaced by its kind in angle brackets; of overlapping spans the first, and the longer of one start, covers the rest."""
    name = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))

    def step(done, s):
        # a span that begins within what is covered only lengthens the cover
        piece = F.concat(F.substring(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0))), F.when(s["start"] >= done["at"], F.element_at(name, s["kind"] + 1)).otherwise(F.lit("")))
        return F.struct(F.greatest(done["at"], -s["end"]).alias("at"), F.concat(done["out"], F.array(piece)).cast("array<string>").alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(ordered, start, step, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all found spans of the text replaced by <email>, <ip>, <card> or <phone>.

    The candidates are looked at twice, once to fit the trees and once to redact, so that no text is
    shuffled and each row keeps its own.  Null texts stay null; repeated rows, null ids and all other
    columns, whatever their names, stay as they are; an empty table gives an empty result."""
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), held_out(id_col, 0).alias("held")).select("row", "held", text.alias("text"))
    rows = rows.select("row", "held", "text", candidates(F.col("text")).alias("found"))
    model, least = fitted(rows.select("held", "found"))
    rows = rows.select("row", "text", "found", base_spans(F.col("text")).alias("base"))
    rows = rows.select("row", "text", "base", added_spans(F.col("base"), F.col("found"), model, least).alias("added"))
    every = F.concat("base", F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    out = rows.select("row", redact(F.col("text"), every).alias("text"))
    clean = F.when(F.col("row")[text_col].isNotNull(), F.col("text"))
    return out.select(*(clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
