"""Variant spellings of one person or committee, linked within a tenant.

Distinct spellings are blocked by phonetic codes and end pieces of their tokens, compared with Jaro-Winkler similarity, an
edit bound and a nickname table, and accepted pairs are clustered by connected components. Short forms (an initial or no
given name, cut words) join a cluster only when no other cluster of the tenant fits them as well.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.runs import key_runs
from civicspark.operators.graph import connected_components
from civicspark.session import cut

#: Common English short forms and the names they stand for.
NICKNAMES = {
    "abby": "abigail", "gail": "abigail", "alex": "alexander", "al": "albert", "andy": "andrew", "drew": "andrew", "tony": "anthony", "barb": "barbara", "ben": "benjamin", "benny": "benjamin",
    "bernie": "bernard", "beth": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine",
    "charlie": "charles", "chuck": "charles", "chris": "christopher", "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard",
    "don": "donald", "doug": "douglas", "ed": "edward", "eddie": "edward", "eliza": "elizabeth", "frank": "francisco", "fran": "francisco", "fred": "frederick", "freddie": "frederick", "gabe": "gabriel",
    "greg": "gregory", "gwen": "gwendolyn", "hank": "henry", "harry": "henry", "jack": "john", "jake": "jacob", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald", "jess": "jessica",
    "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "johnny": "john", "jon": "jonathan", "josie": "josephine", "jo": "josephine", "josh": "joshua", "kate": "katherine",
    "kathy": "katherine", "katie": "katherine", "ken": "kenneth", "kim": "kimberly", "larry": "lawrence", "len": "leonard", "leo": "leonard", "lenny": "leonard", "liz": "elizabeth", "lizzie": "elizabeth",
    "lou": "louis", "lupe": "guadalupe", "maggie": "margaret", "mandy": "amanda", "marge": "margaret", "matt": "matthew", "meg": "margaret", "mel": "melissa", "mickey": "michael", "mike": "michael",
    "nate": "nathaniel", "nathan": "nathaniel", "nat": "nathaniel", "nick": "nicholas", "nicky": "nicholas", "pam": "pamela", "pat": "patricia", "patty": "patricia", "tricia": "patricia", "peg": "margaret",
    "peggy": "margaret", "pete": "peter", "pippa": "philippa", "phil": "philip", "ray": "raymond", "becca": "rebecca", "becky": "rebecca", "rich": "richard", "rick": "richard", "rob": "robert",
    "ron": "ronald", "sam": "samuel", "sammy": "samuel", "sandy": "sandra", "steve": "steven", "sue": "susan", "susie": "susan", "suzy": "susan", "ted": "theodore", "teddy": "theodore",
    "terry": "theresa", "thea": "theodora", "theo": "theodore", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "tori": "victoria", "vicky": "victoria", "vicki": "victoria", "val": "valentina",
    "vince": "vincent", "walt": "walter", "will": "william", "willie": "william", "izzy": "isabella", "bella": "isabella", "zach": "zachary", "zack": "zachary", "zak": "zachary", "xander": "alexander", "abbie": "abigail", "paco": "francisco", "pancho": "francisco", "lupita": "guadalupe", "trish": "patricia", "patsy": "patricia",
    "libby": "elizabeth", "bess": "elizabeth", "lisa": "elizabeth", "topher": "christopher", "kit": "christopher", "debby": "deborah", "debra": "deborah", "greta": "margaret", "isa": "isabella", "jenn": "jennifer",
    "vic": "victor", "rafa": "rafael", "memo": "guillermo", "pepe": "jose", "nacho": "ignacio", "lulu": "lucia", "lucy": "lucia", "sasha": "alexander",
}
#: Short forms that stand for several names.
SEVERAL = {"sam": ("samuel", "samantha"), "alex": ("alexander", "alexandra"), "chris": ("christopher", "christine"), "pat": ("patricia", "patrick"), "theo": ("theodore", "theodora"), "ted": ("theodore", "edward"), "val": ("valentina", "valerie"), "frank": ("francisco", "francis", "franklin"), "will": ("william", "willard"), "gabe": ("gabriel", "gabriela"), "jo": ("josephine", "joanna"), "kate": ("katherine", "catherine"), "al": ("albert", "alan", "alexander"), "ed": ("edward", "edmund"), "nick": ("nicholas", "nicolas"), "phil": ("philip", "philippa", "phillip"), "vic": ("victor", "victoria"), "lou": ("louis", "louise"), "mel": ("melissa", "melvin"), "steve": ("steven", "stephen"), "jon": ("jonathan", "john"), "tony": ("anthony", "antonio"), "fran": ("frances", "francisco"), "bert": ("albert", "robert", "herbert"), "ron": ("ronald", "aaron"), "jess": ("jessica", "jesse"), "beth": ("elizabeth", "bethany"), "dan": ("daniel", "danielle"), "danny": ("daniel", "danielle"), "gail": ("abigail", "gail"), "dora": ("theodora", "dorothy", "isadora"), "tina": ("valentina", "christina", "martina"), "sandy": ("sandra", "alexander", "alexandra"), "lena": ("helena", "elena"), "cat": ("catherine", "catalina"), "leo": ("leonard", "leopold", "leo")}
#: Forms of address and offices before a name.
TITLES = frozenset("dr mr mrs ms miss mx prof professor hon honorable rev sir member trustee director president chair chairman chairwoman chairperson vice superintendent supt secretary treasurer councilmember councilman councilwoman commissioner deputy mayor senator officer clerk attorney the".split())
#: Name suffixes.
SUFFIXES = frozenset("jr sr ii iii iv phd md esq edd".split())
#: Words of committee names that carry no topic, and the kinds of committee.
SMALL = frozenset("the and of on for a".split())
KINDS: tuple[str, ...] = ("advisory board", "board", "subcommittee", "committee", "council", "commission", "taskforce", "working group", "panel")
#: Kinds written by their initials.
INITIALS = {"tf": "taskforce", "wg": "working group", "ab": "advisory board"}

JARO_WINKLER = 0.88
#: Spellings of a block that are compared in one task; of larger blocks, each part is compared with itself and every other.
BLOCK_ROWS = 3000


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c))


def soundex(t: str) -> str:
    """The classic four-place phonetic code."""
    codes = {c: d for d, cs in (("1", "bfpv"), ("2", "cgjkqsxz"), ("3", "dt"), ("4", "l"), ("5", "mn"), ("6", "r")) for c in cs}
    out, last = t[0], codes.get(t[0], "")
    for c in t[1:]:
        d = codes.get(c, "")
        if d and d != last:
            out += d
        if c not in "hw":
            last = d
    return (out + "000")[:4]


@lru_cache(200_000)
def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    used, hits = [False] * m, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    k = len(hits)
    moved = sum(x != y for x, y in zip(hits, (b[j] for j in range(m) if used[j]), strict=True)) / 2
    jaro = (k / n + k / m + (k - moved) / k) / 3
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(n, m))
    return jaro + min(same, 4) * 0.1 * (1 - jaro)


@lru_cache(200_000)
def edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, exact up to 2 (3 stands for more)."""
    if abs(len(a) - len(b)) > 2:
        return 3
    before, row = [], list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        before2, before, row = before, row, [i]
        for j, e in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (c != e))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == e:
                d = min(d, before2[j - 2] + 1)
            row.append(d)
        if min(row) > 2:
            return 3
    return min(row[-1], 3)


def alike(a: str, b: str) -> int | None:
    """Slips between two words: 0 equal, 1 one slip, None not alike. Short words must be equal."""
    if a == b:
        return 0
    if min(len(a), len(b)) < 4 or edits(a, b) > 1 or jaro_winkler(a, b) < JARO_WINKLER and jaro_winkler(a[::-1], b[::-1]) < JARO_WINKLER:
        return None
    return 1


def full_names(given: str) -> tuple[str, ...]:
    if given in SEVERAL:
        return SEVERAL[given]
    return (NICKNAMES[given],) if given in NICKNAMES else (given,)


@dataclass
class Person:
    """A spelling read: given is '' (none), an initial or a name; order says whether the surname is certain."""

    given: str
    surname: str
    middle: str = ""
    nick: str = ""
    sure: bool = True
    tokens: list[str] = field(default_factory=list)


NUMBERED_JAVA = r"(?i)^\W*(?:speaker|spkr|spk|unknown|unk|participant|voice|s)[\W_]*\d*\W*(?:\(.*\))?\W*$"
NUMBERED = re.compile(NUMBERED_JAVA)


def read_person(spelling: str) -> Person | None:
    """None for numbered labels and spellings without a word."""
    if NUMBERED.match(spelling):
        return None
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", spelling)
    s = re.sub(r"\s-\s.*$", " ", s)
    nick = re.search(r"[\"“'‘]([^\W\d_]{2,})[\"”'’](?=\s|$)", s)
    if nick:
        s = s.replace(nick.group(0), " ")
    s = fold(s)
    parts = [re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", p) for p in s.split(",")]
    parts = [[t for t in p if t not in SUFFIXES] for p in parts]
    parts = [p for p in parts if p]
    if parts:
        while len(parts[0]) > 1 and parts[0][0] in TITLES:
            parts[0] = parts[0][1:]
    if len(parts) > 1:
        while parts[1] and parts[1][0] in TITLES and len(parts[1]) > 1:
            parts[1] = parts[1][1:]
    tokens = [t for p in parts for t in p]
    if not tokens:
        return None
    nickname = fold(nick.group(1)) if nick else ""
    if len(parts) > 1:
        surname, rest = " ".join(parts[0]), parts[1]
        return Person(rest[0], surname, next((t[0] for t in rest[1:]), ""), nickname, True, tokens)
    if len(tokens) == 1:
        return Person("", tokens[0], "", nickname, True, tokens)
    middle = next((t[0] for t in tokens[1:-1]), "")
    return Person(tokens[0], tokens[-1], middle, nickname, len(tokens) > 2 or len(tokens[0]) == 1, tokens)


def _given(a: str, b: str) -> tuple[int, bool] | None:
    """(slips, strong) of two given names; None if they differ."""
    if not a or not b:
        return 0, False
    if len(a) == 1 or len(b) == 1:
        return (0, len(a) == len(b) == 1) if any(x[0] == y[0] for x in (a, *full_names(a)) for y in (b, *full_names(b))) else None
    slips = [n for x in {a, *full_names(a)} for y in {b, *full_names(b)} if (n := alike(x, y)) is not None]
    return (min(slips), True) if slips else None


def same_person(a: Person, b: Person) -> str | None:
    """'strong' when surname and given name agree, 'weak' when a given name is short or absent, None otherwise."""
    best = None
    for ga, sa in {(a.given, a.surname)} | (set() if a.sure else {(a.surname, a.given)}):
        for gb, sb in {(b.given, b.surname)} | (set() if b.sure else {(b.surname, b.given)}):
            s = alike(sa, sb)
            g = _given(ga, gb)
            if g is None and s == 0 and len(sa) > 5 and min(len(ga), len(gb)) >= 3 and edits(ga, gb) == 1:
                g = 1, True
            if s is None or g is None or s + g[0] > 2 or len(sa) < 2 or len(sb) < 2:
                continue
            if a.middle and b.middle and a.middle != b.middle and len(a.given) > 1 and len(b.given) > 1:
                continue
            full = len(ga) > 1 and len(gb) > 1
            if full and g[1]:
                return "strong"
            if ga == gb and sa == sb:
                best = "twin"
            best = best or "weak"
    return best


@dataclass
class Committee:
    topics: list[str]
    kind: list[str]
    tokens: list[str] = field(default_factory=list)


def read_committee(spelling: str) -> Committee | None:
    s = fold(re.sub(r"\([^)]*\)", " ", spelling))
    s = re.sub(r"\s[-–—]\s.*$", " ", s)
    s = re.sub(r"\bsub[-\s]+(?=co)", "sub", re.sub(r"\btask[-\s]+force\b", "taskforce", s))
    s = re.sub(r"\b(tf|wg|ab)\W*$", lambda m: INITIALS[m.group(1)], s)
    raw = [t for t in re.findall(r"[^\W\d_]+", s) if t not in SMALL]
    for at_end in (True, False):  # a kind stands last, or first as in "Council on ..."
        for phrase in KINDS:
            ws = phrase.split()
            n = len(ws)
            part, rest = (raw[-n:], raw[:-n]) if at_end else (raw[:n], raw[n:])
            if rest and len(part) == n and all(_short_for(t, w, True) for t, w in zip(part, ws, strict=True)):
                return Committee(rest, ws, raw)
    return Committee(raw, [], raw) if raw else None


def _short_for(t: str, w: str, kind: bool = False) -> bool:
    """t is w, a beginning of it or, for kinds, its letters in order from the first (bd, cmte); one slip is allowed in long words."""
    if t == w or len(w) >= 5 and alike(t, w) is not None:
        return True
    if len(t) >= 3 and w.startswith(t):
        return True
    if kind and len(t) >= 2 and t[0] == w[0] and t[-1] == w[-1] and len(t) < len(w):
        rest = iter(w)
        return all(c in rest for c in t)
    return False


def _match(a: list[str], b: list[str], kind: bool) -> tuple[int, bool] | None:
    """(slips, cut) of a one-to-one assignment of words, in any order."""
    if len(a) != len(b):
        return None
    if not a:
        return 0, False
    best = None
    for k, y in enumerate(b):
        n = alike(a[0], y)
        if n is None and not kind and min(len(a[0]), len(y)) >= 3 and edits(a[0], y) == 1 and max(len(a[0]), len(y)) >= 4:
            n = 1
        short = n is None and (_short_for(a[0], y, kind) or _short_for(y, a[0], kind))
        if n is None and not short:
            continue
        rest = _match(a[1:], b[:k] + b[k + 1 :], kind)
        if rest is not None and (best is None or (rest[1] or short, rest[0] + (n or 0)) < (best[1], best[0])):
            best = (rest[0] + (n or 0), rest[1] or short)
    return best


def same_committee(a: Committee, b: Committee) -> str | None:
    t, k = _match(a.topics, b.topics, False), _match(a.kind, b.kind, True)
    if t is None or t[0] > 2 or (k is None and a.kind and b.kind):
        return None
    if a.topics == b.topics and a.kind == b.kind:
        return "strong"
    return "weak" if t[1] or k is None else "strong"


READ = {"person": read_person, "committee": read_committee}
SAME = {"person": same_person, "committee": same_committee}


#: How much a spelling leaves out: persons 0 full, 1 initial, 2 no given name; committees 1 if all words are cut short.
TIER = {"person": lambda x: 2 if not x.given else int(len(x.given) == 1), "committee": lambda x: int(max(map(len, x.topics)) < 5)}


def block_keys(kind: str, x: Person | Committee) -> set[str]:
    """Codes that survive one slip: the phonetic code, beginning and end of each longer token; three letters of committee words."""
    codes: set[str] = set()
    for t in x.tokens if kind == "person" else x.topics:
        if kind == "committee":
            codes |= {t[:3], "~" + soundex(t)} if len(t) >= 5 else {t[:3]}
        elif len(t) >= 3:
            codes |= {c for n in {t, *full_names(t)} for c in (soundex(n), n[:4] + "-", "-" + n[-4:])}
    return codes


def spellings(df: DataFrame, tenant: str, name: str, kind: str) -> DataFrame:
    return df.select(F.col(tenant).cast("string").alias("tenant_id"), F.lit(kind).alias("kind"), F.col(name).alias("name")).where("tenant_id is not null and trim(name) <> ''").distinct()


def _blocks(names: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for tenant, kind, name in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = READ[kind](name)
                if x is not None:
                    rows += [(tenant, kind, name, k) for k in sorted(block_keys(kind, x))]
            yield pa.RecordBatch.from_pylist([dict(zip(("tenant_id", "kind", "name", "code"), r, strict=True)) for r in rows], schema=pa.schema([("tenant_id", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("code", pa.string())]))

    return names.mapInArrow(run, "tenant_id string, kind string, name string, code string")


def accepted_pairs(names: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(tenant_id, kind, a, b, tier) of spellings that agree, from all blocks, once each.

    A block of more than block_rows spellings is split into parts, and each part is compared with itself and with every
    other. A null tier: both mean one entity. Otherwise a is a short form that fits b, and tier is how short b is (0: full).
    """
    rows = cut(_blocks(names))
    sizes = rows.groupBy("tenant_id", "kind", "code").count().where(F.col("count") > block_rows)
    sizes = sizes.select("tenant_id", "kind", "code", F.ceil(F.col("count") / block_rows).alias("parts"))
    rows = rows.join(sizes, ["tenant_id", "kind", "code"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("name"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    cell = F.xxhash64("tenant_id", "kind", "code", F.least("part", "other"), F.greatest("part", "other"))
    rows = rows.select(cell.alias("block"), "tenant_id", "kind", "code", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict = {}
        schema = pa.schema([(k, pa.string()) for k in ("tenant_id", "kind", "a", "b")] + [("tier", pa.int32())])
        for r in key_runs(batches):
            got, by = [], defaultdict(list)
            for tenant, kind, code, low, high, part, name in zip(*(c.to_pylist() for c in r.columns[1:]), strict=True):
                by[tenant, kind, code, low, high].append((name, part))
            for (tenant, kind, _, low, high), parted in by.items():
                part = dict(parted)
                block = sorted(part)
                if len(read) > 200_000:
                    read.clear()
                for n in block:
                    if (kind, n) not in read:
                        read[kind, n] = READ[kind](n)
                for i, a in enumerate(block):
                    for b in block[i + 1 :]:
                        if low != high and part[a] == part[b]:
                            continue  # met in their own part
                        how = SAME[kind](read[kind, a], read[kind, b])
                        tiers = TIER[kind](read[kind, a]), TIER[kind](read[kind, b])
                        if how == "weak" and tiers[0] != tiers[1]:
                            short, full = (a, b) if tiers[0] > tiers[1] else (b, a)
                            got.append({"tenant_id": tenant, "kind": kind, "a": short, "b": full, "tier": min(tiers)})
                        elif how and how != "weak":
                            got.append({"tenant_id": tenant, "kind": kind, "a": a, "b": b, "tier": None})
            if got:
                yield pa.RecordBatch.from_pylist(got, schema=schema)

    # a stated number: by bytes alone the engine would fold the blocks, whose work is in comparisons, into one task
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "block").sortWithinPartitions("block").mapInArrow(run, "tenant_id string, kind string, a string, b string, tier int").distinct()


def linked_names(names: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(tenant_id, kind, name, entity) for every spelling that can be read; entity is one spelling of the cluster.

    names: tenant_id, kind ('person' or 'committee'), name. Null tenants, null and blank names and numbered labels have no row.
    Spellings stay exactly as stored; equal ones are one. Clusters never cross tenants or kinds. A short form that
    fits several clusters stays on its own.
    """
    numbered = F.col("name").rlike(NUMBERED_JAVA) & (F.col("kind") == "person")
    names = cut(names.select("tenant_id", "kind", "name").where("tenant_id is not null and trim(name) <> ''").where(~numbered).distinct())
    pairs = cut(accepted_pairs(names, block_rows))
    node = lambda c: F.concat_ws("\u001f", "tenant_id", "kind", c)
    strong = connected_components(pairs.where("tier is null").select(node("a").alias("a"), node("b").alias("b")))
    first = names.select("tenant_id", "kind", "name", node("name").alias("node"))
    first = cut(first.join(strong, "node", "left").withColumn("component", F.coalesce("component", "node")))
    comp = first.select("node", "component")
    # a (short form) fits b's cluster; only the clusters with the fullest names that it fits are candidates
    fits = pairs.where("tier is not null").select(node("a").alias("a"), node("b").alias("b"), "tier")
    fits = fits.join(comp.toDF("a", "c"), "a").join(comp.toDF("b", "other"), "b").where("c <> other").groupBy("c", "other").agg(F.min("tier").alias("tier"))
    best = fits.groupBy("c", "tier").agg(F.count("*").alias("n"), F.min("other").alias("other"))
    best = best.groupBy("c").agg(F.min(F.struct("tier", "n", "other")).alias("x")).where("x.n = 1").select(F.col("c").alias("a"), F.col("x.other").alias("b"))
    final = connected_components(best).toDF("component", "whole")
    out = first.join(final, "component", "left").withColumn("whole", F.coalesce("whole", "component"))
    return out.select("tenant_id", "kind", "name", F.element_at(F.split("whole", "\u001f"), -1).alias("entity"))
