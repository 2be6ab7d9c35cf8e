"""Share of a text's characters that repeat earlier content of the same text.

A cascade of rules decides which texts need the exact measure. Every rule is an upper bound of the share, so a text
whose bound is below the threshold is settled; cost and selectivity of the rules are estimated on a bounded sample
of texts, and the rules run in the order of texts settled per second. The order changes the cost alone: the
result of each text is the same under any order.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Runs of so many units (words, or single characters of scripts written without spaces) count as repeated content.
RUN = 4
#: A repeated stretch must hold so many characters, so that set phrases are not counted.
STRETCH = 18
#: Texts of the sample on which cost and selectivity of the rules are estimated, and the most characters that one may have.
SAMPLE, SAMPLE_CHARS = 256, 20_000

_UNIT = re.compile(r"[぀-ヿ㐀-鿿]|[^\W\d_぀-ヿ㐀-鿿]+|\d+(?:[.,:/-]\d+)*")
_COUNTER = re.compile(r"\d[\d.,:/-]*")


def units(text: str) -> list[str]:
    """Words in lower case, ideographs one by one, figures all alike; spacing and punctuation are left out."""
    return _UNIT.findall(_COUNTER.sub("0", text.lower()))


def bound_units(u: list[str]) -> float:
    """Only a unit that stood before can belong to repeated content."""
    total = sum(map(len, u))
    return 1 - sum(map(len, set(u))) / total if total else 0.0


def _bound_grams(n: int) -> Callable[[list[str]], float]:
    def bound(u: list[str]) -> float:
        """A unit of repeated content lies in a repeated run of n units."""
        total = sum(map(len, u))
        if not total or len(u) <= n:
            return 0.0
        seen: set = set()
        reach = hit = 0
        for i, g in enumerate(zip(*(u[k:] for k in range(n)), strict=False)):
            if g in seen:
                hit += sum(map(len, u[max(i, reach) : i + n]))
                reach = i + n
            else:
                seen.add(g)
        return hit / total

    return bound


RULES: dict[str, Callable[[list[str]], float]] = {"units": bound_units, "pairs": _bound_grams(2), "triples": _bound_grams(3)}


def repeated_share(u: list[str], run: int = RUN, stretch: int = STRETCH) -> float:
    """The exact share: characters in maximal stretches of units that repeat earlier runs, stretches of `stretch` characters or more.

    A run shorter than `run` counts where it is directly repeated: the same one, two or three units again and again.
    """
    total = sum(map(len, u))
    if not total:
        return 0.0
    n = len(u)
    cover = bytearray(n)
    seen: set = set()
    for i in range(n - run + 1):
        g = tuple(u[i : i + run])
        if g in seen:
            cover[i : i + run] = b"\1" * run
        else:
            seen.add(g)
    for period in range(1, run):
        same = 0
        for i in range(period, n):
            same = same + 1 if u[i] == u[i - period] else 0
            if same >= max(2 * period, run - 1):
                cover[i - same + 1 : i + 1] = b"\1" * same
    hit = size = 0
    for i in range(n + 1):
        if i < n and cover[i]:
            size += len(u[i])
        else:
            hit += size if size >= stretch else 0
            size = 0
    return hit / total


def plan_rules(sample: list[list[str]], threshold: float) -> list[str]:
    """Rules by texts settled per second on the sample; a rule that settles none is left out."""
    worth = {}
    for name, rule in RULES.items():
        began = time.perf_counter()
        settled = sum(rule(u) < threshold for u in sample)
        worth[name] = settled / max(time.perf_counter() - began, 1e-9)
    return sorted((n for n, w in worth.items() if w > 0), key=lambda n: -worth[n])


def repetition(df: DataFrame, text: str = "text", threshold: float = 0.3, sample: int = SAMPLE, order: list[str] | None = None) -> DataFrame:
    """df without its text, with `repeated_share`, `share_bound`, `decided_by` and `repetitive` (share >= threshold).

    Texts settled by a bound have a null repeated_share, the bound and the rule's name; all others have the exact
    share. Null, empty and wordless texts have the share 0 (decided_by 'empty'). Any length is read whole.
    Clashing column names are refused. `order` fixes the rules instead of the sample (SAMPLE texts of SAMPLE_CHARS at most,
    fit for nothing but the order, which by its timing may differ from run to run, and decided_by and share_bound with it).
    """
    new = ["repeated_share", "share_bound", "decided_by", "repetitive"]
    keep = [c for c in df.columns if c != text]
    if clash := set(new) & set(keep):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    if order is None:
        some = [units(r[0]) for r in df.select(text).where(f"length(`{text}`) <= {SAMPLE_CHARS}").limit(sample).collect()]
        order = plan_rules(some, threshold)
    rules = [(n, RULES[n]) for n in order]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("repeated_share", T.DoubleType()), T.StructField("share_bound", T.DoubleType()), T.StructField("decided_by", T.StringType()), T.StructField("repetitive", T.BooleanType())])

    def decide(t: str | None) -> tuple[float | None, float, str, bool]:
        u = units(t) if t else []
        if not u:
            return 0.0, 0.0, "empty", False
        for name, rule in rules:
            if (x := rule(u)) < threshold:
                return None, x, name, False
        x = repeated_share(u)
        return x, x, "exact", x >= threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.float64(), pa.float64(), pa.string(), pa.bool_()]
        for b in batches:
            rows = [decide(t) for t in b.column(len(keep)).to_pylist()]
            cols = [pa.array([r[k] for r in rows], kinds[k]) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *cols], names=schema.names)

    return df.select(*keep, text).mapInArrow(run, schema)
