import numpy as np
import pytest

from tidemark.llm.pii import find_pii, mask_pii, masked, spans_of, tagged_spans
from tidemark.llm.pii_labels import KINDS, Labeller
from tidemark.llm.tagger import N_TAGS, OVERLAP, WINDOW, Tagger, load, model_bytes
from tidemark.llm.tagger_training import HIDDEN, start_weights, step, tag_row


@pytest.fixture(scope="module")
def tagger():
    return load(model_bytes())


TEXTS = [
    ("My name is Arric Tarnander. Call me at (306) 555-0174.", {("name", "Arric Tarnander"), ("phone", "(306) 555-0174")}),
    ("Write to garwen.nolundgar@mail.nolundgar.example about the vet.", {("email", "garwen.nolundgar@mail.nolundgar.example")}),
    ("Social security no. 944-32-3685 is on file. Order 923971 cost 12.50.", {("id_number", "944-32-3685")}),
    ("我家住在橘子市晚霞区白鹭巷39号。请打133-0000-5196联系我。", {("address", "橘子市晚霞区白鹭巷39号"), ("phone", "133-0000-5196")}),
    ("Garnol hat heute Morgen die Kekse aus Garvarom nicht gefressen.", set()),
    ("Parcel TK-2024-723190 is due. PETFACT-164325 stays as it is.", set()),
]


@pytest.mark.parametrize("text, want", TEXTS)
def test_known_cases(tagger, text, want):
    [spans] = tagged_spans(tagger, [text])
    assert {(k, text[a:b]) for a, b, k in spans} == want


def test_held_out_accuracy(tagger):
    """On rows the weights were not fitted to: another mix of the listed names, unseen numbers and carriers."""
    rng = np.random.default_rng(123)
    first, last = ["Arric", "Yarko", "Silisa", "Orneth", "Gwelin", "Beltte"], ["Tarnander", "Vexbury", "Haskmoor", "Dunidge", "Ostrescu", "Lundmoor"]
    hit = have = want = 0
    for _ in range(150):
        name = f"{first[rng.integers(6)]} {last[rng.integers(6)]}"
        mail = f"{''.join(rng.choice(list('abdefgilmnor'), 7))}{rng.integers(99)}@{''.join(rng.choice(list('abdefgilmnor'), 6))}.example"
        phone = f"+1 {rng.integers(200, 999)} 555 01{rng.integers(10, 99)}"
        text = f"The blanket is grey. We met {name} at the pond. Write to {mail} about the vet. Call me at {phone}. The export ran at night and left {rng.integers(30)} rows behind."
        truth = {(text.index(name), "name"), (text.index(mail), "email"), (text.index(phone), "phone")}
        got = {(a, k) for a, _, k in tagged_spans(tagger, [text])[0]}
        hit, have, want = hit + len(truth & got), have + len(got), want + len(truth)
    assert hit / have >= 0.95 and hit / want >= 0.95


def test_long_texts_are_decoded_in_overlapping_windows(tagger):
    filler = "The grey leash hangs behind the door next to the coat. "
    for shift in range(0, WINDOW, 37):
        text = filler * 10
        text = text[: 300 + shift] + " Write to staros.omwen@stayor.example about the vet. " + filler * 20
        assert {(k, text[a:b]) for a, b, k in tagged_spans(tagger, [text])[0]} == {("email", "staros.omwen@stayor.example")}
    assert OVERLAP < WINDOW


def test_masking_keeps_the_rest(tagger):
    text = "My name is Arric Tarnander. Call me at (306) 555-0174."
    assert masked(text, tagged_spans(tagger, [text])[0]) == "My name is [NAME]. Call me at [PHONE]."
    assert masked("x", []) == "x"


def test_spans_are_widened_to_whole_words():
    text = "to anna.b@x.example now"
    tags = np.zeros(len(text), np.int8)
    tags[5:12] = 2 + 2 * KINDS.index("email")
    assert [(text[a:b], k) for a, b, k in spans_of(text, tags)] == [("anna.b@x.example", "email")]
    tags[:] = 0
    tags[0] = 1 + 2 * KINDS.index("phone")
    assert spans_of(text, tags) == []


def test_tables(spark):
    df = spark.createDataFrame([("a", TEXTS[0][0], 1), ("b", None, 2), ("c", "", 3), ("d", " \n", 4), ("a", TEXTS[0][0], 5), ("e", "x" * 50_000, 6), ("f", "\U0001f600 " + TEXTS[0][0], 7)], "id string, content string, start_at int")
    got = sorted((r.id, r.kind, r.start_at) for r in find_pii(df, "content", ["id"]).collect())
    assert got == [("a", "name", 11), ("a", "name", 11), ("a", "phone", 39), ("a", "phone", 39), ("f", "name", 13), ("f", "phone", 41)]
    assert find_pii(df.where("false"), "content", ["id"]).count() == 0
    with pytest.raises(ValueError):
        find_pii(df.withColumnRenamed("id", "kind"), "content", ["kind"])
    out = {r.id: r.masked for r in mask_pii(df, "content").collect()}
    assert out["a"] == "My name is [NAME]. Call me at [PHONE]." and out["b"] is None and out["c"] == ""


def test_gradients_match_differences():
    class Small:
        size = 12

    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in start_weights(Small, rng).items()}
    w["trans"] += rng.normal(size=w["trans"].shape) * 0.1
    ids = rng.integers(0, 12, (7, 3)).astype(np.int32)
    tags = rng.integers(0, N_TAGS, (7, 3))
    lengths = np.array([7, 5, 3])
    for t in range(7):
        ids[t, lengths <= t] = 0
    _, g = step({k: v.astype(np.float32) for k, v in w.items()}, ids, tags, lengths)
    for name in w:
        flat = w[name].reshape(-1)
        for at in rng.choice(flat.size, 4, replace=False):
            old, eps = flat[at], 1e-2
            flat[at] = old + eps
            up, _ = step({k: v.astype(np.float32) for k, v in w.items()}, ids, tags, lengths)
            flat[at] = old - eps
            down, _ = step({k: v.astype(np.float32) for k, v in w.items()}, ids, tags, lengths)
            flat[at] = old
            assert g[name].reshape(-1)[at] == pytest.approx((up - down) / (2 * eps), abs=3e-3)
    assert HIDDEN == w["u"].shape[1]


def test_best_path_matches_all_paths():
    rng = np.random.default_rng(1)

    class Small:
        size = 12

    w = start_weights(Small, rng)
    w["trans"] = rng.normal(size=w["trans"].shape)
    tagger = Tagger(w, "abcd")
    scores = rng.normal(size=(3, 2, N_TAGS)).astype(np.float32)
    path = tagger.best_path(scores, np.array([3, 2]))
    for j, n in ((0, 3), (1, 2)):
        best = max(np.ndindex(*[N_TAGS] * n), key=lambda p: tagger.first[p[0]] + tagger.last[p[-1]] + sum(scores[t, j, p[t]] for t in range(n)) + sum(tagger.trans[p[t], p[t + 1]] for t in range(n - 1)))
        assert path[:n, j].tolist() == list(best)


def test_labels():
    label = Labeller(["Arric Tarnander", "林以棠"])
    text = "Tell ARRIC  TARNANDER or 林以棠: +44 7700 900668, QQ186122A, 6 bakelzel Road, Apt 14, x_1 (at) y (dot) org"
    got = [(text[a:b], k) for a, b, k in label(text)]
    assert got == [("ARRIC  TARNANDER", "name"), ("林以棠", "name"), ("+44 7700 900668", "phone"), ("QQ186122A", "id_number"), ("6 bakelzel Road, Apt 14", "address"), ("x_1 (at) y (dot) org", "email")]
    assert tag_row("ab c", [(0, 2, "name")]).tolist() == [1, 2, 0, 0]
    new, spans = label.varied(text, np.random.default_rng(0))
    assert [k for _, _, k in spans] == [k for _, k in got] and all(0 <= a < b <= len(new) for a, b, _ in spans)


def test_names_of_no_list_in_sentences_of_no_training_text():
    from tidemark.llm.pii_labels import made_up_name
    from tidemark.llm.tagger import load, model_bytes

    rng = np.random.default_rng(77)
    frames = [("latin", "Yesterday {} came by with the blue bowl."), ("latin", "Die Leine gehört {}, sagte sie."), ("han", "昨天{}把蓝色的碗带来了。"), ("kana", "昨日{}が青い器を持ってきた。")]
    texts, want = [], []
    for k in range(400):
        kind, frame = frames[k % 4]
        name = made_up_name(rng, kind)
        texts.append(frame.format(name))
        want.append((frame.index("{"), frame.index("{") + len(name), "name"))
    found = tagged_spans(load(model_bytes()), texts)
    assert sum(w in f for w, f in zip(want, found, strict=True)) >= 0.5 * len(want)  # 211 of 400 when the model was trained
