"""C28 against a plain scan of each sentence."""

import random

from storygraph.operators import analytics as A

TITLES = ("mr. ", "mr ", "mrs. ", "mrs ", "miss ", "dr. ", "dr ", "professor ", "colonel ", "inspector ")


def scan(text, labels):
    """Segments of a text; labels: (entity, type, label) in order."""
    forms = {}
    for entity, kind, label in labels:
        title = next((t for t in TITLES if label.lower().startswith(t)), "")
        for form in [label, *([label[len(title) :]] if title and len(label) - len(title) > 2 else [])]:
            if form:
                forms[form.lower()] = (entity, kind)
    out, at, low = [], 0, text.lower()
    while at < len(text):
        hit = max((f for f in forms if low.startswith(f, at)), key=len, default=None)
        if hit:
            out.append((text[at : at + len(hit)], *forms[hit]))
        elif out and out[-1][1] is None:
            out[-1] = (out[-1][0] + text[at], None, None)
        else:
            out.append((text[at], None, None))
        at += len(hit or "x")
    return out


def test_tagged_like_a_plain_scan(spark):
    rnd = random.Random(5)
    words = ["Mr. Élan", "élan", "Dr Who", "who", "Who's", "a+b", "(a", "a", "Miss Al", "al", "Colonel  Bo", "Inspector Bob", "Bob", "bobby", "[x]", "$", "^", "x|y", "\\d", "mr Bob", "МИР", ""]
    sentences, labels = [], {}
    for i in range(400):
        some = rnd.sample(words, rnd.randint(0, 5))
        some = [w for w in some if "  " not in w]
        labels[str(i)] = [(f"e{k}", "character", w) for k, w in enumerate(some)]
        text = rnd.choice(["", " "]).join(rnd.choice([w, w.upper(), w.lower(), "é"]) for w in rnd.choices(words, k=rnd.randint(0, 9)))
        sentences.append(("s", str(i), text))
    rows = [("s", i, k, *x) for i, ls in labels.items() for k, x in enumerate(ls)]
    got = A.tagged(spark.createDataFrame(sentences, "story string, id string, text string"), spark.createDataFrame(rows, "story string, id string, ord int, entity string, type string, label string")).collect()
    assert len(got) == 400
    for r in got:
        text = sentences[int(r["id"])][2]
        want = scan(text, labels[r["id"]])
        assert [tuple(x) for x in r["segments"] if x["text"]] == want, (text, labels[r["id"]])
