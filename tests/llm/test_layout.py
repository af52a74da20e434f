import json
import random
from collections import defaultdict

from siftstone.llm.layout import canonical, copies_by_layout, equal_contents, named_fields

FIELDS = {"Title": "the quiet river: a history", "Year": "1876", "Shelf": "L5268", "Author": "Rilbrizan Ephpra"}


def cards(fields, draw):
    items = list(fields.items())
    draw.shuffle(items)
    return [
        "\n".join(f"{k}: {v}" for k, v in items),
        " | ".join(f"{k.lower()}: {v.lower()}" for k, v in items),
        "; ".join(f"{k.upper()}: {v}" for k, v in items) + ".",
        json.dumps({k.lower(): v for k, v in items}, ensure_ascii=False),
        "\n".join(f"- **{k}**: {v}" for k, v in items),
        "> " + "\r\n\r\n> ".join(f"{k} : {v}" for k, v in items),
    ]


def test_cards_in_all_layouts_are_equal():
    draw = random.Random(1)
    assert len({canonical(t)[1] for _ in range(5) for t in cards(FIELDS, draw)}) == 1
    other = FIELDS | {"Year": "1877"}
    swapped = FIELDS | {"Year": FIELDS["Shelf"], "Shelf": FIELDS["Year"]}
    assert len({canonical(cards(f, draw)[0])[1] for f in (FIELDS, other, swapped)}) == 3


def test_what_is_no_card():
    for t in ("A sentence: with a colon. And more text follows here", "Year: 1876", "[00:43] Neshol: hello\n[01:32] Neseph: there", "{not json: at all", "plain text"):
        assert named_fields(t) is None


def test_names_and_values_of_any_shape():
    fields = {"Name of the keeper of the northern shelf of the old reading room": "Rilbrizan", "Year": "1876.50", "Keys": "a1, b2, c3", "Note": "kept: always"}
    made = cards(fields, random.Random(2))
    assert len({canonical(t)[1] for t in made}) == 1 and canonical(made[0])[1] is not None
    one = '{"keys": ["a1", "b2", "c3"], "note": "kept: always", "year": 1876.50, "Name of the keeper of the northern shelf of the old reading room": "RILBRIZAN"}'
    assert canonical(one)[1] == canonical(made[0])[1]
    assert canonical(one.replace('"a1", "b2"', '"b2", "a1"'))[1] != canonical(one)[1]
    nested = '{"size": {"w": 1, "h": null}, "ok": true, "list": [{"b": 1, "a": 2}]}'
    turned = '{"list": [{"a": 2, "b": 1}], "ok": TRUE, "size": {"h": null, "w": 1}}'.replace("TRUE", "true")
    assert canonical(nested)[1] == canonical(turned)[1] is not None
    for t in ("x" + " " * 200_000, "a " * 100_000 + ":\n" * 3, "{" * 50_000 + "}" * 50_000, "[" * 20 + "{" + "[" * 100_000 + "}"):
        canonical(t)  # ends, and soon


def test_layout_changes_do_not_matter():
    t = "The quick (brown) fox, no. 9,\njumps over the lazy dog — twice!"
    for u in (t.upper(), t.replace(" ", "  "), "** " + t + "​", "the quick brown fox no 9 jumps over the lazy dog twice"):
        assert canonical(u)[0] == canonical(t)[0]
    assert canonical(t + "1")[0] != canonical(t)[0]
    assert canonical("Straße")[0] == canonical("STRASSE")[0]


def brute(rows):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, t in rows:
        if t is not None and len(t) >= 40:
            for key in canonical(t):
                if key is not None:
                    a, b = find(key), find(i)
                    if a != b:
                        up[b] = a
    groups = defaultdict(list)
    for i, t in rows:
        if t is not None and len(t) >= 40:
            groups[find(i)].append(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def test_table(spark):
    draw = random.Random(4)
    rows = []
    for k in range(30):
        prose = f"Document number {k} says that {'many ' * draw.randrange(1, 6)}things are so."
        rows += [prose] * draw.randrange(1, 4) + [prose.upper()] + draw.sample(cards(FIELDS | {"Edition": str(k)}, draw), 3)
    rows += ["hot copy of a text that has a third of all rows"] * 120 + [None, None, "", "x" * 39, "!" * 50, "?" * 60]
    draw.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, raw string, copies int").repartition(6)
    got = [(r["first_doc"], r["doc_id"]) for r in copies_by_layout(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    groups, _ = equal_contents(df)
    assert groups.agg({"copies": "sum"}).first()[0] == sum(t is not None and len(t) >= 40 for _, t in rows)
    assert copies_by_layout(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    text = "One page with more than forty characters, again."
    df = spark.createDataFrame([(1, text), (1, text), (2, text.upper()), (2, text.upper()), (3, text)], "doc_id long, text string")
    assert sorted(map(tuple, copies_by_layout(df).collect())) == [(1, 2), (1, 3)]
    assert [tuple(r) for r in equal_contents(df)[0].select("first_doc", "copies").collect()] == [(1, 5)]


def test_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {(r["first_doc"], r["doc_id"]) for r in copies_by_layout(docs).collect()} == brute(rows)
