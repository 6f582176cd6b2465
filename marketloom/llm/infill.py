"""Fill-in-the-middle: every text is cut into prefix, middle and suffix, which are put in another order.

Units are runs of ASCII letters and every other code point on its own.  The
two cuts, the plain share and the order come from digits of the SHA-256 of
``seed:id``, so a document is cut alike wherever and whenever it is read.  A
batch goes through Arrow kernels only: units are split into list arrays,
flattened with the index of their parent, numbered, filtered by role, rebuilt
as lists and joined.  Unit ends are marked with the byte FF, which no UTF-8
text holds, so texts may hold any character.

Defined cases: a null text stays null (plain, no units); an empty text is
plain; a null id draws as the empty id; equal rows get equal results; an empty
table gives an empty table; extra columns pass through, but a column named as
the result gives way.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.words import slices

RESULT = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint>"
KIND = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])

#: A unit in UTF-8 bytes: a run of letters, another ASCII byte, or a lead byte with what follows it.
UNIT = rb"([A-Za-z]+|[\x00-\x40\x5B-\x60\x7B-\x7F]|[\xC0-\xFE][\x80-\xBF]*)"
END = b"\xff"
DRAWS = "_infill_draws"


@dataclass(frozen=True)
class Rule:
    """Signs before the three parts, percent of plain texts, percent of the others in suffix-prefix-middle order, and the seed."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain: int = 10
    spm: int = 20
    seed: str = "1"

    def signs(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(doc_id: str, rule: Rule) -> Column:
    """Four unsigned 32-bit numbers of a document."""
    digits = F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)])


def _modulo(a, b):
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _pieces(units, ordinal, parent, low, high):
    """The units of every parent with low <= ordinal < high, joined."""
    inside = pc.and_(pc.greater_equal(ordinal, pc.take(low, parent)), pc.less(ordinal, pc.take(high, parent)))
    ends = pc.cumulative_sum(pc.subtract(high, low))
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), ends])
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, pc.filter(units, inside)), pa.scalar(b"", pa.large_binary()))


def _cut(texts: pa.Array, drawn: pa.Array, rule: Rule) -> tuple[pa.Array, pa.Array]:
    """The new texts and the result structs of a slice."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    marked = pc.replace_substring_regex(raw, pattern=UNIT, replacement=rb"\1" + END)
    parts = pc.split_pattern(marked, END).cast(pa.large_list(pa.large_binary()))  # the last part of a text is empty
    units, parent = pc.list_flatten(parts), pc.list_parent_indices(parts)
    n = pc.subtract(pc.list_value_length(parts), 1).cast(pa.int64())
    starts = pc.subtract(parts.offsets[:-1], parts.offsets[0]).cast(pa.int64())
    ordinal = pc.subtract(pa.array(range(len(units)), pa.int64()), pc.take(starts, parent))
    h = [pc.list_element(drawn, k) for k in range(4)]
    one, two = (_modulo(x, pc.add(n, 1)) for x in h[:2])
    first, second, zero = pc.min_element_wise(one, two), pc.max_element_wise(one, two), pc.subtract(n, n)
    prefix, middle, suffix = (_pieces(units, ordinal, parent, *span) for span in ((zero, first), (first, second), (second, n)))
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_modulo(h[2], 100), 100 - rule.plain))
    for sign in rule.signs():
        plain = pc.or_(plain, pc.match_substring(raw, sign.encode()))
    spm = pc.less(_modulo(h[3], 100), rule.spm)
    p, s, m = (pa.scalar(x.encode(), pa.large_binary()) for x in rule.signs())
    none = pa.scalar(b"", pa.large_binary())
    turned = pc.if_else(spm, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none), pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none))
    out = pc.if_else(plain, raw, turned).cast(pa.large_string())
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x.cast(pa.large_string())).cast(pa.int64())) for x in (prefix, middle)]
    return pc.if_else(pc.is_null(texts), pa.scalar(None, pa.large_string()), out), pa.StructArray.from_arrays([n, form, *chars], fields=list(KIND))


def _run(text: str, into: str, rule: Rule):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                out, found = _cut(batch.column(text), batch.column(DRAWS), rule)
                kept = {n: batch.column(n) for n in batch.schema.names if n != DRAWS}
                kind = kept[text].type
                yield pa.RecordBatch.from_pydict(kept | {text: out.cast(kind), into: found})

    return run


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "infill", rule: Rule = Rule()) -> DataFrame:
    """Replaces every text by its three parts behind their signs and adds ``into``: units, form (plain, psm, spm), code points of prefix and middle.

    A text that holds a sign, or no unit, stays plain.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (into, DRAWS)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{into}` {RESULT}"
    return docs.withColumn(DRAWS, draws(doc_id, rule)).mapInArrow(_run(text, into, rule), schema)


def restore(text: Column, form: Column, rule: Rule = Rule()) -> Column:
    """The text from which ``transform`` made this one."""
    p, s, m = rule.signs()
    after = lambda c, sign: F.split_part(c, F.lit(sign), F.lit(2))
    before = lambda c, sign: F.split_part(c, F.lit(sign), F.lit(1))
    psm = F.concat(before(after(text, p), s), after(text, m), before(after(text, s), m))
    spm = F.concat(before(after(text, p), m), after(text, m), before(after(text, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)
