"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class; DataFrame functions only.

One pass marks assignments such as ``token = ...``; another marks runs of characters that tokens are made of.  Access
ids, hex strings and the entropy candidates are all looked for inside those runs, which are a small part of the text.

Entropy: for each character class a candidate is a maximal run of its characters, at least one window long.  The window
moves one character at a time; the counts of its characters, packed ten to a long, and the sum of c * log2(c) are updated
for the character that leaves and the one that enters.  Windows at or over the class's threshold are joined into spans where
they overlap.  Long runs are walked in blocks that overlap by a window, so that the work grows with their length.
Allow-list patterns of whole candidates (plain words) pass a candidate over; those found anywhere in it (placeholders,
alphabets, repeats) pass over the windows that overlap what they match, and a window beginning or ending up to REACH characters from
the word of a placeholder.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS, HEX = r"(AKIA[A-Z0-9]+)", r"([0-9a-f]+)"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16
#: Runs that can hold an access id, a hex string or an entropy candidate.
RUN = r"((?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{16,})"
#: name: (characters, window, threshold in bits a character)
CLASSES = {
    "hex": ("0123456789abcdef", 24, 3.0),
    "caps": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20, 3.6),
    "mixed": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 20, 3.7),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 32, 4.2),
}
#: Classes whose windows have to hold a small letter, a capital and a digit with a letter somewhere behind it, so that joined
#: words are no candidates.
HOLDS = ("mixed",)
ALLOWED = (r"^[a-z]+$", r"^[A-Z]?[a-z_-]+$", r"(?i)example", r"(?i)x{6,}", r"0123456789", r"(?i)abcdefghij", r"(.)\1{7,}", r"^[-=_+/]+$")
#: Allow-list patterns that speak for what stands next to them, and how far.
NEXT_TO, REACH = (r"(?i)example",), 32
#: Separates marked matches from the rest; where a text holds it, it is read as MARK2, which no pattern matches either.
MARK, MARK2, BLOCK = "\x01", "\x02", 128
#: Window starts of a run that are walked together, and counts in a long: six bits each, for windows of up to 63 characters.
STRETCH, PACKED, COUNT_BITS = 1024, 10, 6


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _starts(parts: Column) -> Column:
    """Where each part begins, in code points, if all stand one after the other; sums over blocks keep it near linear."""

    def inner(lens: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / BLOCK).cast("int")), lambda b: _sum(F.slice(lens, b * BLOCK + 1, F.lit(BLOCK))))
        before = let(blocks, lambda s: F.transform(s, lambda _, b: _sum(F.slice(s, F.lit(1), b))))
        return let(before, lambda s: F.transform(lens, lambda _, i: F.get(s, F.floor(i / BLOCK).cast("int")) + _sum(F.slice(lens, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))

    return let(F.transform(parts, lambda p: F.char_length(p)), inner)


def matches(text: Column, pattern: str, least: int = 0, group: int = 1) -> Column:
    """The leftmost non-overlapping matches of ``pattern`` (its first group spans it all): array of (s, e, t), code points,
    end exclusive; those whose ``group`` has under ``least`` characters are dropped after they were matched."""

    def of(parts: Column) -> Column:
        placed = let(_starts(parts), lambda starts: F.transform(parts, lambda p, i: F.struct(F.get(starts, i).alias("s"), (F.get(starts, i) + F.char_length(p)).alias("e"), p.alias("t"))))
        kept = F.filter(placed, lambda x, i: i % 2 == 1)
        if least:
            kept = F.filter(kept, lambda x: F.char_length(F.regexp_extract(x["t"], pattern, group) if group > 1 else x["t"]) >= least)
        return kept

    marked = F.regexp_replace(F.translate(text, MARK, MARK2), pattern, f"{MARK}$1{MARK}")
    none = F.filter(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("t"))), lambda x: F.lit(False))
    return let(F.split(marked, MARK), lambda parts: F.when(F.size(parts) > 1, of(parts)).otherwise(none))


def inside(runs: Column, pattern: str, least: int, test: str) -> Column:
    """``matches`` within each run that ``test`` is found in, placed in the text."""
    return F.flatten(F.transform(F.filter(runs, lambda r: r["t"].rlike(test)), lambda r: F.transform(matches(r["t"], pattern, least), lambda x: F.struct((r["s"] + x["s"]).alias("s"), (r["s"] + x["e"]).alias("e"), x["t"].alias("t")))))


def _no_spans() -> Column:
    return F.filter(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))), lambda x: F.lit(False))


def joined(spans: Column) -> Column:
    """Spans (s, e), of which none begins or ends before the one in front of it, with those that meet as one."""

    def of(v: Column) -> Column:
        first = F.filter(v, lambda x, i: (i == 0) | (F.get(v, i - 1)["e"] < x["s"]))
        last = F.filter(v, lambda x, i: (i == F.size(v) - 1) | (F.get(v, i + 1)["s"] > x["e"]))
        return F.zip_with(first, last, lambda x, y: F.struct(x["s"].alias("s"), y["e"].alias("e")))

    return let(spans, of)


def hot_windows(run: Column, alphabet: str, width: int, least: float, barred: Column | None = None, mixed: bool = False) -> Column:
    """The joined windows of ``run`` (a string over ``alphabet``) with an entropy of ``least`` bits or more, as array of (s, e),
    but for those that meet a span of ``barred`` and, with ``mixed``, those without a small letter, a capital and a digit with
    a letter behind it."""
    logs = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)])
    # entropy >= least exactly if the sum of c * log2(c) is at most this
    most = width * (math.log2(width) - least) + 1e-9
    kinds = {k: F.array(*[F.lit(kind(c)) for c in alphabet]) for k, kind in (("lower", str.islower), ("upper", str.isupper), ("digit", str.isdigit))} if mixed else {}

    def fold(codes: Column, begin: Column, end: Column, near: Column | None) -> Column:
        """The spans of windows that end from ``begin`` + width on and before ``end``, with what lies before them as a run-up."""
        state = [F.array_repeat(F.lit(0).cast("long"), -(-len(alphabet) // PACKED)).alias("counts"), F.lit(0.0).alias("g"), *[F.lit(-1).alias(k) for k in (*kinds, "found") if mixed], _no_spans().alias("spans")]

        def step(a: Column, i: Column) -> Column:
            new, old = F.get(codes, i), F.when(i - begin >= width, F.get(codes, i - width)).otherwise(F.lit(-1))
            bits = lambda c: (c % PACKED) * COUNT_BITS
            count = lambda c: F.call_function("shiftright", F.get(a["counts"], F.floor(c / PACKED).cast("int")), bits(c)).bitwiseAND(F.lit((1 << COUNT_BITS) - 1).cast("long")).cast("int")
            n_new, n_old = count(new), F.when(old >= 0, count(old)).otherwise(F.lit(0))
            gain = F.when(old == new, F.lit(0.0)).otherwise(F.get(logs, n_new + 1) - F.get(logs, n_new) + F.when(old >= 0, F.get(logs, n_old - 1) - F.get(logs, n_old)).otherwise(F.lit(0.0)))
            one = lambda c, j: F.when(j == F.floor(c / PACKED).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), bits(c))).otherwise(F.lit(0).cast("long"))
            counts = F.transform(a["counts"], lambda c, j: c + one(new, j) - F.when(old >= 0, one(old, j)).otherwise(F.lit(0).cast("long")))
            # places of the last character of each kind, and of the last digit that a letter stands behind
            at = {k: F.when(F.get(kind, new), i).otherwise(a[k]) for k, kind in kinds.items()}
            if mixed:
                at["found"] = F.when(~F.get(kinds["digit"], new), a["digit"]).otherwise(a["found"])

            def placed(g: Column) -> Column:
                start, last = i - (width - 1), F.try_element_at(a["spans"], F.lit(-1))
                good = (start >= begin) & (g <= most)
                for k in ("lower", "upper", "found") if mixed else ():
                    good = good & (at[k] >= start)
                if near is not None:
                    good = good & ~F.exists(near, lambda x: (x["s"] < start + width) & (x["e"] > start))
                grown = F.concat(F.slice(a["spans"], F.lit(1), F.size(a["spans"]) - 1), F.array(F.struct(last["s"].alias("s"), (i + 1).alias("e"))))
                added = F.concat(a["spans"], F.array(F.struct(start.alias("s"), (i + 1).alias("e"))))
                spans = F.when(~good, a["spans"]).when(F.coalesce(last["e"] >= start, F.lit(False)), grown).otherwise(added)
                return F.struct(counts.alias("counts"), g.alias("g"), *[at[k].alias(k) for k in (*kinds, "found") if mixed], spans.alias("spans"))

            return let(a["g"] + gain, placed)

        return F.aggregate(F.sequence(begin, end - 1), F.struct(*state), step, lambda a: a["spans"])

    def blocks(codes: Column) -> Column:
        def block(b: Column) -> Column:
            # windows that start from b * STRETCH on, up to the next block's first
            begin, end = b * STRETCH, F.least(F.size(codes), (b + 1) * STRETCH + width - 1)
            if barred is None:
                return fold(codes, begin, end, None)
            return let(F.filter(barred, lambda x: (x["s"] < end) & (x["e"] > begin)), lambda near: fold(codes, begin, end, near))

        return joined(F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(codes) - 1) / STRETCH).cast("int")), block)))

    codes = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return let(codes, blocks)


def _shifted(alphabet: str, width: int, least: float, found: tuple, mixed: bool) -> Callable[[Column], Column]:
    """Hot windows of a run placed in the text, but for those that meet what the patterns ``found`` match."""

    def of(x: Column) -> Column:
        def spans(barred: Column | None) -> Column:
            return F.transform(hot_windows(x["t"], alphabet, width, least, barred, mixed), lambda y: F.struct((x["s"] + y["s"]).alias("s"), (x["s"] + y["e"]).alias("e")))

        def reached(patterns: tuple, reach: int) -> Column:
            return F.transform(matches(x["t"], f"({_any(patterns)})"), lambda m: F.struct((m["s"] - reach).alias("s"), (m["e"] + reach).alias("e")))

        near, only = tuple(p for p in found if p in NEXT_TO), tuple(p for p in found if p not in NEXT_TO)
        each = [reached(p, r) for p, r in ((near, REACH), (only, 0)) if p]
        return let(F.concat(*each), spans) if each else spans(None)

    return of


def _any(patterns: tuple) -> str:
    return "|".join(f"(?:{a})" if "\\1" not in a else a.replace("(.)", "(?<rep>.)").replace("\\1", "\\k<rep>") for a in patterns)


def _kind(k: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["s"].cast("int").alias("s"), F.lit(k).alias("k"), x["e"].cast("int").alias("e"))


def entropy_spans(runs: Column, classes: dict = CLASSES, allowed: tuple = ALLOWED) -> Column:
    """Spans (s, e) of all classes' hot windows within the runs; equal spans of two classes count once."""
    found = []
    whole = tuple(a for a in allowed if a.startswith("^") and a.endswith("$"))
    parts = tuple(a for a in allowed if a not in whole)
    for name, (alphabet, width, least) in classes.items():
        chars = "".join("\\" + c if c in "-=+/_" else c for c in alphabet)
        pattern = f"([{chars}]{{{width},}})"
        kept = inside(runs, pattern, width, pattern)
        if whole:
            kept = F.filter(kept, lambda x: ~x["t"].rlike(_any(whole)))
        found.append(F.flatten(F.transform(kept, _shifted(alphabet, width, least, parts, name in HOLDS))))
    return F.array_distinct(F.concat(*found))


def scan(df: DataFrame, text: str = "text", classes: dict = CLASSES, allowed: tuple = ALLOWED) -> DataFrame:
    """Add ``n_assign``, ``n_access``, ``n_hex``, ``n_entropy`` and ``found``, the array of (s, k, e): code points, kind as an
    index into KINDS, end exclusive, ordered by start and kind.

    Base patterns: leftmost non-overlapping per kind, a match that is too short is dropped after it was consumed.  A null
    or empty text has no spans.  Rows are handled one by one: repeated rows repeat, an empty table stays empty.  Columns of
    ``df`` named like the added ones are replaced; those named ``__runs``, ``__assign``, ``__access``, ``__hex``
    or ``__entropy`` are dropped.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = df.withColumns({"__runs": matches(whole, RUN), "__assign": matches(whole, ASSIGN, ASSIGN_MIN, 2)})
    spans = marked.withColumns({"__access": inside(F.col("__runs"), ACCESS, ACCESS_MIN, "AKIA"), "__hex": inside(F.col("__runs"), HEX, HEX_MIN, f"[0-9a-f]{{{HEX_MIN}}}"), "__entropy": entropy_spans(F.col("__runs"), classes, allowed)})
    names = ["__assign", "__access", "__hex", "__entropy"]
    each = [F.transform(F.col(c), _kind(k)) for k, c in enumerate(names)]
    sizes = {f"n_{k}": F.size(c).cast("long") for k, c in zip(KINDS, names, strict=True)}
    # the partition id is always there; naming it keeps the optimiser from copying these large expressions into later filters
    found = F.when(F.spark_partition_id() >= 0, F.array_sort(F.concat(*each)))
    return spans.withColumns(sizes | {"found": found}).drop("__runs", *names)


def spans_text(found: Column, kinds: int) -> Column:
    """``kind:start:end`` of the spans of the first ``kinds`` kinds, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.filter(found, lambda x: x["k"] < kinds), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))))


def digest(df: DataFrame) -> DataFrame:
    """The report of a scan: doc_id, counts, the digest of the base spans, all spans as text."""
    got = scan(df.select("doc_id", "text"))
    return got.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans_text(F.col("found"), 3), 256).alias("base_sha256"), spans_text(F.col("found"), len(KINDS)).alias("spans"), "n_entropy")


def redact(df: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Put ``mark`` in the place of every span (overlapping ones together) in ``text``; same columns, ``n_chars``, where
    present, counts anew for changed texts.  Null texts stay null, texts without spans stay as they are."""
    # the row travels as one column, so that no name of the scan meets one of the table's
    got = scan(df.select(F.struct(*df.columns).alias("__row"), "text"))
    merged = F.aggregate(
        F.col("found"),
        F.filter(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))), lambda x: F.lit(False)),
        lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["e"] >= x["s"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["s"].alias("s"), F.greatest(F.element_at(a, -1)["e"], x["e"]).alias("e")))))
        .otherwise(F.concat(a, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))),
    )

    def cut(spans: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["e"]))
        starts = F.concat(F.transform(spans, lambda x: x["s"]), F.array(F.char_length("text")))
        return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(F.col("text"), a + 1, b - a)), mark)

    masked = got.select("__row", F.when(F.size("found") > 0, let(merged, cut)).alias("__masked"))

    def column(name: str) -> Column:
        old = F.col(f"__row.`{name}`")
        if name == "text":
            return F.coalesce("__masked", old).alias(name)
        if name == "n_chars":
            return F.coalesce(F.char_length("__masked").cast(df.schema[name].dataType), old).alias(name)
        return old.alias(name)

    return masked.select(*[column(c) for c in df.columns])
