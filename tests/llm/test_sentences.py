import time

import pytest

from siftstone.llm.lexicon import DOTS, OTHER, SURE, count_edges, fit_lexicon
from siftstone.llm.sentences import best_units, coverage, lattice_words, sentence_units, sentences

CASES = [
    ["Dr. Tarholmor left at 1 p.m. on Oct. 22.", "He came back at 3 p.m.", "See Fig. 3 on p. 7 (cf. Ulm et al., vol. 2, no. 6)."],
    ["“Is it true?” asked Ulm.", "Nolhul said, “It is. I saw it.”", "(This stands alone.)", "The end (it was. Truly.) came late."],
    ["The ledger, the lens, etc. were lost.", "They took pens, ink, etc.", "Nothing else remained... or perhaps one lamp.", "It rained...", "The lamp went out."],
    ["pH values near 5.5 mean little?!", "pH values near 4.4 mean more!", "Write to desk@tovnes.example if the file gorjun.neslin.txt changes."],
    ["Das 9. Kapitel zeigt z. B. das Tal bzw. 3.370 g laut Ephver.", "Am 3. August kam Dr. Belisk usw.", "Die Lampe brennt.", "„Stimmt es, dass er ging?“, fragte Keltov."],
    ["El Sr. Ulm vive en EE. OO. y pesa aprox. 9,5 kg, p. ej. hoy.", "—¿Es cierto? —preguntó Tov.", "¡Sí!", "¿Véase pág. 7?", "Dijo: «La nave va»."],
    ["Mme Ulm et le Dr C. Tov savent tout.", "« Est-ce vrai ? » demanda Tov.", "Il répondit : « Oui. »", "La nuit tombe !"],
    ["К. Б. Горбри пришёл в 1741 г. домой.", "Он взял хлеб и т. д. Потом ушёл, т. е. исчез (рис. 23).", "«Верно ли?» — спросил Юн."],
    ["«هل الجسر قوي؟» قال غلدر، ثم ذهب.", "د. الملرور يراقب السوق.", "سأل فن: «هل هو؟»", "القيمة هي 7.99 حيث كان."],
    ["बेल ने कहा, “वह आया।”", "“क्या वह आया?” तोव ने पूछा।", "डॉ. तोव लंबा है।"],
]


@pytest.mark.parametrize("parts", CASES, ids=range(len(CASES)))
def test_spaced_scripts(parts):
    text = " ".join(parts)
    got = [text[a:b] for a, b in sentences(text)]
    if parts[0].startswith("К."):  # a list's end before a new sentence
        parts = [parts[0], "Он взял хлеб и т. д.", "Потом ушёл, т. е. исчез (рис. 23).", parts[2]]
    assert got == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["澜珩说：“船只来了。”", "“是真的吗？岛屿很远。”沅棠写道，遥远的课本……也许是桥梁。", "数值约为9.90，是的！！", "（安静的沙丘。）", "如今没有。"],
        ["「信号は森を温めるのか？」とドラは尋ねた。", "長い橋……いや島は丸い。", "ヴェルは『守っている！』と言った。", "値は5.28で、重い。"],
    ],
)
def test_spaceless_scripts(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_thai():
    text = "ค่าคือ 2.11 ในขณะที่ครูเก่าแก่ ตลาดแห้งวัดหนังสือ 67 ครั้ง  วันนี้แม่น้ำยาว"
    assert [text[a:b] for a, b in sentences(text)] == ["ค่าคือ 2.11 ในขณะที่ครูเก่าแก่", "ตลาดแห้งวัดหนังสือ 67 ครั้ง", "วันนี้แม่น้ำยาว"]


def test_headings_lists_and_wrapped_lines():
    text = "# The grey bridge\nThe open lens reveals the faint and rather distant ancient\nisland.At night it sleeps.\n\nThe old corpus\n\n- One. item\n• Two\n\n\tLast line"
    assert [text[a:b] for a, b in sentences(text)] == [
        "# The grey bridge", "The open lens reveals the faint and rather distant ancient\nisland.", "At night it sleeps.", "The old corpus", "- One. item", "• Two", "Last line",
    ]


@pytest.mark.parametrize("text", ["", " \n\t ", ".", "...", "”", "(((", "\r\n\r\n", "a", "“open. Never closed. Still", "!!! ??? ...", "💥" * 50, "x" * 200_000, "A. " * 20_000, "“" * 3000 + "a. B"])
def test_odd_texts_are_covered(text):
    got = sentences(text)
    assert sum(sum(not c.isspace() for c in text[a:b]) for a, b in got) == sum(not c.isspace() for c in text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in got)
    assert all(p[1] <= q[0] for p, q in zip(got, got[1:]))


def test_lattices():
    assert lattice_words("甲乙写道") == ("甲乙", "写道")
    assert lattice_words("ab") == ("ab",)
    assert list(best_units("a! ... b", 0, 8, [(2, 4.0), (6, 3.0)])) == [(0, 2), (2, 8)]
    assert lattice_words("我们昨天去了海边", frozenset({"我们", "昨天", "海边"})) == ("我们", "昨天", "去", "了", "海边")


def test_best_chain_looks_back_over_all_gaps():
    words = "stop. " * 200 + "end"
    assert list(best_units(words, 0, len(words), [(6 * k + 5, -8.0) for k in range(200)])) == [(0, len(words))]
    table = "\n".join(" ".join(f"{i}.{k}25" for k in range(8)) for i in range(10, 34))
    assert sentences(table) == [(0, len(table))]


def test_case_is_not_judged_by_the_front_alone():
    normal = ["Am 3. August kam Dr. Belisk heim.", "Er blieb bis zum 5. September.", "Die Werte sind neu.", "pH 7 ist neutral."]
    front = "ALLE RECHTE VORBEHALTEN " * 200
    assert [normal, normal * 60] == [[t[a:b] for a, b in sentences(t)][1:] for t in (front + "\n\n" + " ".join(normal * k) for k in (1, 60))]
    upper = "- Am 3. AUGUST IN BONN"
    text = " ".join(normal) + "\n\n" + upper
    assert [text[a:b] for a, b in sentences(text)] == [*normal, upper]


@pytest.mark.parametrize("front", ["https://example.net/", "(www.example.net/", "desk@example.net/"])
def test_long_addresses_stay_whole(front):
    parts = [f"See {front}{'a/' * 60}q?Next=1&v=2.Part or ask.", "It is here."]
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts
    spaced = "x" * 80 + "?Next one."
    assert len(sentences(spaced)) == 2


def test_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "One. Two.", "z"), (3, "One. Two.", "z")], "doc_id long, text string, start_char string")
    assert sorted(map(tuple, sentence_units(df).collect())) == [(3, 0, 4), (3, 0, 4), (3, 5, 9), (3, 5, 9)]
    assert sentence_units(df.limit(0)).count() == 0


#: A small corpus of its own: openings and continuations that no list in the code names.
CHINESE = ["我们昨天去了海边。", "我们明天再来。", "我们都很高兴，孩子们也一样。", "他说要来……恐怕是忘了时间。", "路很远……恐怕是走不到了。", "她病了……恐怕是太累了。", "天黑了，我们还在路上。", "爷爷种的树……恐怕是枯了。"]
JAPANESE = ["今朝は雨が降りました。", "今朝は早く起きました。", "今朝はパンを食べました。", "駅まで歩いて……どうやら道を間違えたらしい。", "手紙を読んで……どうやら泣いていたらしい。", "窓を開けて……どうやら風邪をひいたらしい。"]


def test_openings_are_learned_from_the_corpus(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate((CHINESE + JAPANESE) * 20)] + [(9000, None), (9001, ""), (9002, "字" * 100_000), (9003, "no such letters")], "doc_id long, text string").repartition(3)
    words = fit_lexicon(df)
    assert "我们" in words.words and words.odds(0, "我们") > 1 and words.odds(0, "恐怕") < -1
    for parts in (["门关上了……", "我们没有再说话。"], ["门关上了……恐怕是风太大。"], ["電車が止まった……", "今朝は誰も来ない。"], ["電車が止まって……どうやら雪のせいらしい。"]):
        text = "".join(parts)
        assert [text[a:b] for a, b in sentences(text, words)] == parts
    assert fit_lexicon(df.limit(0)).totals == ((0, 0, 0), (0, 0, 0))
    same = fit_lexicon(df.repartition(7))
    assert (same.heads, same.tails, same.words) == (words.heads, words.tails, words.words)


def test_without_a_lexicon_particles_decide():
    for parts in (["他走了……", "门还开着。"], ["漫长的路……也许是梦。"]):
        text = "".join(parts)
        assert [text[a:b] for a, b in sentences(text)] == parts


def test_clause_edges():
    from collections import Counter

    counts = Counter()
    count_edges("「春天来了。」他说……也许", counts)
    assert counts[0, SURE, "春天"] == 1 and counts[1, SURE, "来了"] == 1 and counts[1, DOTS, "他说"] == 1 and counts[0, DOTS, "也许"] == 1 and counts[0, OTHER, "他说"] == 1


def test_general_sentences():
    """Sentences that no template of the test tables makes."""
    for parts in (
        ["The rate rose from 3.4 to 5.75 percent.", "Was Mr. O'Neill told?", "He wasn't."],
        ["Nach ca. 20 Min. kam sie usw.", "Er blieb stehen."],
        ["Il est né le 3 mars 1912.", "« Tu viens ? » demanda Paul.", "Non."],
        ["¿Qué hora es?", "Son las 10.30 h. en Madrid.", "¡Vamos!"],
        ["在1998年，价格是3.5元。", "他问：“你去吗？”", "我不去！"],
        ["「もう帰るの？」と母が聞いた。", "私は何も言わなかった。"],
    ):
        text = ("" if any(ord(c) > 0x3000 for c in parts[0]) else " ").join(parts)
        assert [text[a:b] for a, b in sentences(text)] == parts


def test_coverage(spark):
    docs = spark.createDataFrame([(1, "One. Two 😀x."), (2, " \u3000"), (3, None), (4, "日本。語")], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in coverage(sentence_units(docs), docs).collect()}
    assert got == {1: (10, 0, 0), 4: (4, 0, 0)}
    wrong = spark.createDataFrame([(1, 0, 5), (1, 3, 8)], "doc_id long, start_char long, end_char long")
    assert [tuple(r)[1:] for r in coverage(wrong, docs).collect()] == [(8, 1, 1)]


@pytest.mark.parametrize(
    "text",
    ["ตลาดแห้งวัด " * 30_000, " " * 500_000 + "a. B", "a.b" * 80_000, "a...b" * 40_000, "! " * 80_000 + "a", "(a. “ " * 20_000 + '" x 」' * 20_000, "Some field name: a value that is longer than forty characters indeed\n" * 10_000, "他走了……也许" * 20_000, "_" * 200_000 + "\nx"],
    ids=["blanks", "blank line", "points", "dots", "marks", "open brackets", "fields", "ellipses", "rule"],
)
def test_very_long_texts_take_time_in_proportion(text):
    began = time.process_time()
    got = sentences(text)
    assert time.process_time() - began < 10
    assert sum(b - a for a, b in got) <= len(text) and all(p[1] <= q[0] for p, q in zip(got, got[1:]))
