import json
import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from civicspark.operators import nested
from civicspark.operators.graph import connected_components


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(110)] + [(1000, 1000 + k) for k in range(300)] + [(k, k + 1) for k in range(2000, 2060)]
    edges += [(None, 5), (7, 7), edges[0]]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for x in list(root)}
    got = connected_components(spark.createDataFrame(edges, "a int, b int")).collect()
    assert {r[0]: r[1] for r in got} == want and len(got) == len(want)


def test_components_empty(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


leaf = st.one_of(st.none(), st.text(max_size=3))
items = st.one_of(st.none(), st.lists(st.one_of(st.none(), st.fixed_dictionaries({"i": leaf, "l": st.one_of(st.none(), st.lists(st.one_of(st.none(), st.fixed_dictionaries({"h": leaf})), max_size=3))})), max_size=3))
record = st.one_of(st.none(), st.lists(st.one_of(st.none(), st.fixed_dictionaries({"c": leaf, "items": items})), max_size=3))
KIND = pa.list_(pa.struct([("c", pa.string()), ("items", pa.list_(pa.struct([("i", pa.string()), ("l", pa.list_(pa.struct([("h", pa.string())])))])))]))


@settings(max_examples=150, deadline=None)
@given(st.lists(record, max_size=5))
def test_shredding_gives_what_walking_gives(records):
    leaves = nested.shred(pa.array(records, KIND))
    g = lambda x, k: None if x is None else x[k]
    want = [(n, a, b, c, g(cat, "c"), g(it, "i"), g(li, "h")) for n, r in enumerate(records) for a, cat in enumerate(r or []) for b, it in enumerate(g(cat, "items") or []) for c, li in enumerate(g(it, "l") or [])]
    t = nested.assemble(leaves, ("items", "l"))
    got = list(zip(*(list(t[k]) for k in ("record", "ord_1", "ord_2", "ord_3")), t["c"].to_pylist(), t["items/i"].to_pylist(), t["items/l/h"].to_pylist(), strict=True))
    assert [tuple(map(lambda v: v if v is None or isinstance(v, str) else int(v), r)) for r in got] == want
    want = [(n, a, b, g(cat, "c"), g(it, "i")) for n, r in enumerate(records) for a, cat in enumerate(r or []) for b, it in enumerate(g(cat, "items") or [])]
    t = nested.assemble(leaves, ("items",))
    assert [(int(a), int(b), int(c), d, e) for a, b, c, d, e in zip(t["record"], t["ord_1"], t["ord_2"], t["c"].to_pylist(), t["items/i"].to_pylist(), strict=True)] == want


def test_sliced_arrays():
    rows = [[{"c": "x", "items": [{"i": "1", "l": None}]}], None, [{"c": "y", "items": [{"i": "2", "l": [{"h": "z"}]}, None]}]]
    t = nested.assemble(nested.shred(pa.array(rows, KIND).slice(1)), ("items",))
    assert t["items/i"].to_pylist() == ["2", None] and t["c"].to_pylist() == ["y", "y"] and list(t["record"]) == [1, 1]


def test_payload_layouts():
    items = [{"itemId": "A", "itemOrder": 2.0, "itemName": "n", "subItems": [{"itemId": "B"}]}, {"itemId": None}]
    base = [{"categoryId": "C", "items": items}]
    want = [("A", None, "2"), ("B", "A", None), (None, None, None)]
    for o in ({"categories": base}, {"categories": base[0]}, {"meeting": {"categories": base}}, {"categories": json.dumps(base)}, {"categories": {"C": {"items": items}}}):
        got = nested.payload_categories(json.dumps(o))
        assert [c["category_id"] for c in got] == ["C"], o
        assert [(i["item_id"], i["parent_item_id"], i["item_order"]) for i in got[0]["items"]] == want
    keyed = nested.payload_categories(json.dumps({"categories": [{"category_id": "C", "items": {"A": {"item_name": "n"}, "B": {}}}, {"category_id": "D", "items": {}}]}))
    assert [[i["item_id"] for i in c["items"]] for c in keyed] == [["A", "B"], []]
    assert nested.payload_categories('{"categories": [') is None and nested.payload_categories(None) is None and nested.payload_categories("{}") == []


def test_tables_with_odd_rows(spark):
    schema = "id int, ord int, categories array<struct<category_id:string,category_order:string,category_name:string,items:array<struct<item_id:string,item_order:string,item_name:string,links:array<struct<link_order:string,link_key:string,href:string,link_text:string,filename:string>>>>>>"
    rows = [(1, 5, None), (2, 5, []), (None, 5, [None, ("c", None, None, [("i", "1", None, None), None])]), (3, 5, [(None, None, None, [("i", "1", "x", [("1", "k", None, None, None)])])])]
    df = spark.createDataFrame(rows + rows[3:], schema)
    got = sorted(map(tuple, nested.items_table(df, ["id", "ord"]).select("id", "ord", "category_id", "item_id").collect()), key=str)
    assert got == sorted([(None, 5, "c", "i"), (None, 5, "c", None), (3, 5, None, "i"), (3, 5, None, "i")], key=str)
    assert nested.links_table(df, ["id"]).count() == 2
    assert nested.categories_table(df, ["id"]).count() == 4
    assert nested.items_table(df.limit(0), ["id"]).count() == 0
