import pytest

from marlspike.llm import pii

FIRST = "Janim Sola Hura Forel Vadia Fena Juma Nedia Trida Wizin".split()
LAST = "Roskovan Quirazi Zoskeman Getrarin Stutrovan Sonwick Drulelli Puleen".split()
PLAIN = ["I moved from Wadi Plol to Umm Dree in the week of July 10", "Where is order #4528306 of 5748 AED from Treloor", "the clerk at the Jaikrian desk noted reference 7635346091", "My bill for 24-6 shows AED 848", "what should I do now about case 85469201"]


def phone(i):
    return [f"+971 50 {i % 900 + 100} 4567", f"055{1_000_000 + i * 7919 % 8_999_999}", f"05{i % 9}-{i % 900 + 100}-4567", " ".join(["zero", "five", "six", "one", "two", "nine", "eight"][j % 7] for j in range(i % 7, i % 7 + 10))][i // 7 % 4]


@pytest.fixture(scope="module")
def model():
    out = []
    for i in range(700):
        f, l = FIRST[i % 10], LAST[(i * 7) % 8]
        kind = [(f"my name is {f} {l}", "my name is <NAME>"), (f"call me on {phone(i)}", "call me on <PHONE>"), (f"write to {f.lower()}_{i}@mail.example", "write to <EMAIL>"), (f"ID: 784-1990-{1000000 + i}-1", "ID: <EID>"), (f"deliver to house no {i % 90 + 1}, Foti Avenue, Ras Taub", "deliver to <ADDRESS>"), ("thank you", "thank you"), (f"passport no. K{4000000 + i}", "passport no. K")][i % 7]
        t = PLAIN[i % 5]
        out.append((f"{t}. {kind[0]}", f"{t}. {kind[1]}" if i % 3 else None))
    return pii.train(out)


def kinds(model, text):
    [(offs, lab)] = model.label([text])
    return {k for k, _, _ in pii.kinds_in(text, offs, lab)} if lab.any() else set()


@pytest.mark.parametrize(
    ("text", "want"),
    [("please help. my name is Vadia Drulelli", {"NAME"}), ("please call me on 055-165-6679", {"PHONE"}), ("call me on ٠٥٦٠٨٠١٨٥٣ now", {"PHONE"}), ("write to janim.quirazi @ mail.example", {"EMAIL"}), ("write to hura (at) mail (dot) example", {"EMAIL"}), ("ID: 784/1986/1255231/6", {"ID"}), ("deliver to house no 93, Goq Avenue, Al Poo", {"ADDRESS"}), ("whatsapp zero five six zero eight two five one two six", {"PHONE"}), (PLAIN[1], set()), (PLAIN[2], set()), ("call <PHONE> now", set()), ("ｃａｌｌ ｍｅ ｏｎ ０５５１８５１６９６", {"PHONE"})],
)
def test_kinds(model, text, want):
    assert kinds(model, text) == want


def test_edges(model):
    assert model.label([""])[0][0] == [] and not model.label(["😡 !!"])[0][1].any()
    long = "word " * 20_000 + "call me on 055-165-6679"
    assert kinds(model, long) == {"PHONE"}


def test_frame(spark, model):
    df = spark.createDataFrame([(1, "call me on 055-165-6679 today", "x"), (2, None, "y"), (3, "", "z"), (1, "call me on 055-165-6679 today", "x")], "request_id long, text string, kinds string")
    got = {(r["request_id"], r["masked"]): r["kinds"] for r in pii.find_personal_data(df, model, ("request_id",)).collect()}
    assert got == {(1, "call me on <PHONE> today"): ["PHONE"], (2, None): [], (3, ""): []}
    assert pii.find_personal_data(df.limit(0), model, ("request_id",)).count() == 0


def test_skip_edges_join_distant_repetitions():
    assert pii.skip_edges(["Janim", "went", "home", "said", "janim", "Janim"]) == [(0, 4)]
    # the same stem, and the same digits in another cut
    assert pii.skip_edges(["Roskovan", "paid", "for", "roskova"]) == [(0, 3)]
    assert pii.skip_edges(["call", "0551656679", "or", "055", "-", "165", "-", "6679"]) == [(1, 3)]
    assert pii.links([["Vadia", "called"], ["then", "Vadia"]]) == [(0, 0, 1, 1)]


def test_an_unmarked_second_mention_takes_the_label_of_the_first():
    import numpy as np

    cues = [("my name is {}", "my name is <NAME>"), ("this is {} here", "this is <NAME> here"), ("{} speaking", "<NAME> speaking")]
    pairs = []
    for i in range(900):
        name = f"{FIRST[i % 10]}{'lmnrst'[i % 6]}{'aeiou'[i // 7 % 5]} {LAST[(i * 7) % 8][:-3]}{'aeiou'[i % 5]}{'lmnrstkv'[i // 3 % 8]}en"
        cue, masked = cues[i % 3]
        pairs.append((f"{PLAIN[i % 5]}. {cue.format(name)}. {PLAIN[(i + 2) % 5]}", f"{PLAIN[i % 5]}. {masked}. {PLAIN[(i + 2) % 5]}" if i % 2 else f"{PLAIN[i % 5]}. {cue.format(name)}. {PLAIN[(i + 2) % 5]}!"))
    m = pii.train(pairs)
    assert m.skip[5, 5] > m.skip[5, 0]
    text = "my name is Vadiala Drullaren. the clerk told vadiala drullaren to wait"
    at = text.index("vadiala")

    def second():
        [(offs, lab)] = m.label([text])
        return [int(k) for (a, _), k in zip(offs, lab, strict=True) if a >= at][:2]

    both = second()
    m.skip, m.from_skip, m.quiet = np.zeros_like(m.skip), 0.0, 99.0
    m.clear()
    assert both == [5, 5] and second() != [5, 5]


def test_no_belief_exceeds_the_bound():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(30):
        u, c, s = (rng.normal(size=x).astype(np.float32) for x in ((3, 7, pii.K), (pii.K, pii.K), (pii.K, pii.K)))
        n = np.array([7, 4, 1])
        edges = [(0, 0, 3), (0, 1, 5), (0, 3, 6), (1, 0, 2)]
        m = pii.Model({}, np.zeros((1, pii.K), np.float32), np.zeros((5, pii.K), np.float32), np.zeros(pii.K, np.float32), c, s + s.T)
        b = m.marginals(u, n, edges)
        odds = np.log(b[:, :, 1:] / b[:, :, :1])
        most = m.most(u, n, edges)
        assert all((odds[i, : n[i]] <= most[i, : n[i]] + 1e-3).all() for i in range(3))


def test_inference_is_exact_on_chains():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    u, c = rng.normal(size=(1, 4, pii.K)).astype(np.float32), rng.normal(size=(pii.K, pii.K)).astype(np.float32)
    m = pii.Model({}, np.zeros((1, pii.K), np.float32), np.zeros((5, pii.K), np.float32), np.zeros(pii.K, np.float32), c, np.zeros((pii.K, pii.K), np.float32))
    want = np.zeros((4, pii.K))
    for y in itertools.product(range(pii.K), repeat=4):
        s = np.exp(sum(u[0, i, y[i]] for i in range(4)) + sum(c[y[i], y[i + 1]] for i in range(3)))
        for i in range(4):
            want[i, y[i]] += s
    want /= want.sum(1, keepdims=True)
    assert np.allclose(m.marginals(u, np.array([4]), [])[0], want, atol=1e-4)
