import time

import pytest

from tidemark.llm.sentences import ASKING, STERM, sentence_spans, sentences

CASES = [
    ["The train leaves at 2 p.m.", "We walked on."],
    ["At 7 a.m. Anna woke up, at 5 p.m. Bert slept.", "All was well."],
    ["The sign was made in the U.S.", "J. K. Stone painted the sign in Jan. 2021."],
    ["The list had bowls, brushes, etc.", "27 notes were merged on Tuesday at approx. 3:30."],
    ["The store moved from v2.8.11 to v1.2.", "v0.1.11 shipped without the patch."],
    ['She said: "The gate is open."', "They (see p. 3) kept the collar."],
    ['"Is it time?" Anna seemed to ask.', "Nobody knew."],
    ['He wrote: "The red one. Not the blue one!" and left.', "We stayed."],
    ['The sign says "Closed!" in red letters.', "(The bowl was empty again.)", "The Zing! brand sold it."],
    ["We waited ... and then it came.", "The kettle started...", "Is the bowl clean?!"],
    ["It was warm. 🐾", "See No. 11 in the list, e.g. the harness."],
    ["Dr. Holt met Mr. and Mrs. Stone vs. the club.", "The file notes.x.txt was read at 6.30 and closed."],
    ["The crate belongs to Zorn Inc.", "The Zorn Inc. manual lists 3 parts."],
    ["Das 2. Kapitel, Abs. 2, nennt u. a. das Futter.", "Am 20. März war Dr. Holt da.", "Die Version 1.1 ersetzte die Version 3.9.", "Der Export lief."],
    ["„Wir sind spät. Nimm die Straße“, sagte sie und ging.", "Auf dem Schild steht „Geschlossen!“ in Rot.", "Sie sagte: „Das Tor ist offen.“", "Wo ist es?"],
    ["El Sr. Moor y la Dra. Wick pesaron a Omba a las 1 a. m. en la clínica.", "«Es tarde. Toma el camino», dijo ella.", "¿Comió ayer?"],
    ["L'art. 9 de l'av. Omba, cf. chap. 9, reste valable.", "« Est-ce l'heure ? » semblait demander Omba.", "Elle a dit : « La porte est ouverte. »", "Où est-il ?"],
    ["कंबल 23 दिनों से अलमारी में है।", '"अब चलते हैं। रात हो गई।" कहकर उसने दरवाज़ा बंद किया।', "डॉ. ने 4.30 बजे पंजा देखा।"],
    ["هل أكل فستق أمس؟", "وصل د. إلى العيادة ومعه النسخة 1.8.0.", "أين الفرشاة؟"],
]
CJK = [
    ["我们等了很久……最后墨点回来了。", "晚饭改到了傍晚……", "他写道：「蓝色的那个。不是那个！」就离开了。", "她说：“门开了。”", "“现在几点了？”墨点好像在问。", "牌子上写着“关门！”三个字。", "(碗又空了。)", "比例从19.1%降到15.32%。"],
    ["看板には「閉店！」とだけある。", "彼女の返事は「門は開いている。」", "「もう行こう。暗くなるよ。」と彼女は言った。", "しばらく待った……やっと戻った。"],
]


@pytest.mark.parametrize("parts", CASES)
def test_spaced_scripts(parts):
    for joint in (" ", "\n", "\n\n", "  ", "\r\n \r\n"):
        text = joint.join(parts)
        assert [text[a:b] for a, b in sentence_spans(text)] == parts, joint


@pytest.mark.parametrize("parts", CJK)
def test_scripts_without_spaces(parts):
    for joint in ("", "\n", "\n\n"):
        text = joint.join(parts)
        assert [text[a:b] for a, b in sentence_spans(text)] == parts, joint


def test_thai():
    text = "ผ้าห่มอยู่ในตู้มา26วันแล้ว แปรงขนหายไปตั้งแต่เมื่อวาน ระบบบันทึกข้อมูลใหม่28รายการ"
    assert [text[a:b] for a, b in sentence_spans(text)] == text.split(" ")


def test_headings_wraps_and_missing_spaces():
    text = "Weekly notes\n \nThe summary\nwas long.The next one came.\n\nthe end"
    assert [text[a:b] for a, b in sentence_spans(text)] == ["Weekly notes", "The summary\nwas long.", "The next one came.", "the end"]
    low = "is the bowl clean again? the new bed arrived, e.g. today. done."
    assert [low[a:b] for a, b in sentence_spans(low)] == ["is the bowl clean again?", "the new bed arrived, e.g. today.", "done."]


@pytest.mark.parametrize("text", [None, "", "  \n\n ", "　"])
def test_nothing(text):
    assert sentence_spans(text) == []


@pytest.mark.parametrize("text", ["a" * 100_000, "a. " * 50_000, '"' * 20_000, "(" * 20_000, ". " * 1000, "“a" * 5000, "…" * 1000, "\ud83d x."])
def test_odd_texts_keep_order(text):
    last = 0
    for a, b in sentence_spans(text):
        assert last <= a < b <= len(text) and not text[a].isspace() and not text[b - 1].isspace()
        last = b


def test_table(spark):
    df = spark.createDataFrame([(1, "One. Two.", "x"), (2, None, "x"), (3, " ", "x"), (1, "One. Two.", "x")], "doc_id bigint, text string, start_at string")
    assert sorted(tuple(r) for r in sentences(df).collect()) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert sentences(df.where("false")).count() == 0


@pytest.mark.parametrize(
    "parts",
    [
        ["the train leaves at 9 p.m.", "can you remind me?", "the crate belongs to zorn inc.", "how long does it last?!", "the zorn inc. manual lists 3 parts."],
        ["the sign was made in the u.s.", "which of the 9 notes is still valid?", "it cost 3, etc. as the list shows.", "dr. holt checked it at 8 a.m. and wrote a note."],
        ['she said: "the gate is open."', 'the sign says "closed!" in red letters.', "j. k. stone painted it in jan. 2021.", "v2.1 shipped.", "the zing! brand sold it.", "der 9. eintrag usw. wurden gelöscht."],
    ],
)
def test_paragraphs_without_capitals(parts):
    text = "A heading\n\n" + " ".join(parts)
    assert [text[a:b] for a, b in sentence_spans(text)] == ["A heading", *parts]


def test_every_terminator_of_the_standard_ends_a_sentence():
    assert len(STERM) > 150 and {"။", "។", "።", "؟", "!", "?"} <= STERM and {"!", "?", "؟"} <= ASKING
    for c in sorted(STERM):
        text = f"Aaa bbb{c} Ccc ddd{c}"
        assert [text[a:b] for a, b in sentence_spans(text)] == [f"Aaa bbb{c}", f"Ccc ddd{c}"], hex(ord(c))


@pytest.mark.parametrize(
    "parts",
    [
        ["Он живёт на ул. Ленина, д. 5.", "Это было в 2020 г. в Москве.", "Хлеб, молоко и т.д. лежали там."],
        ["မြို့သို့သွားသည်။", "ပြန်လာသည်။"],
        ["គាត់ទៅផ្សារ។", "គាត់ត្រឡប់មកវិញ។"],
        ["ሰላም ነው።", "እንደምን ነህ?"],
        ["Price is 3.50 and the size is 5. It fits.".split(". ")[0] + ".", "It fits."],
    ],
)
def test_further_scripts(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentence_spans(text)] == parts


def test_abbreviations_are_those_of_the_language():
    german = "Der Hund und die Katze sind bei der Fa. Holt. Es ist warm."
    assert [german[a:b] for a, b in sentence_spans(german)] == ["Der Hund und die Katze sind bei der Fa. Holt.", "Es ist warm."]
    english = "The song of the choir was in the key of fa. The end of it was good."
    assert [english[a:b] for a, b in sentence_spans(english)] == ["The song of the choir was in the key of fa.", "The end of it was good."]
    short = "Siehe Abs. Zwei."
    assert len(sentence_spans(short)) == 1


def test_a_long_quotation_is_one_sentence_and_a_stray_mark_pairs_with_nothing():
    inside = "We walk. " * 500
    text = f"She said: “{inside}” and left. We stayed."
    assert [b - a for a, b in sentence_spans(text)][1:] == [len("We stayed.")]
    text = 'The board is 5" wide. It fits. The sign says "Closed!" in red.'
    assert [text[a:b] for a, b in sentence_spans(text)] == ['The board is 5" wide.', "It fits.", 'The sign says "Closed!" in red.']


@pytest.mark.parametrize("text", ["(" * 400_000, "“a. " * 100_000, '"' * 400_000, "„a“ " * 100_000, "usw. a " * 60_000])
def test_time_grows_with_the_length(text):
    began = time.perf_counter()
    sentence_spans(text)
    assert time.perf_counter() - began < 20
