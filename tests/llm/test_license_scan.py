import random
import re

import pyarrow as pa
import pytest

from bagstats.llm.license_scan import LEAST, PHRASES, TEMPLATES, scan_licenses, split_words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(text, templates, phrases, threshold):
    words = _words(text)
    places = [(k, label) for label, p in phrases for k in range(len(words)) if words[k : k + len(_words(p))] == _words(p)]
    matches = []
    for t, (label, template) in enumerate(templates):
        wanted, span = set(_words(template)), LEAST
        while span < len(_words(template)):
            span *= 2
        blocks = max(1, -(-len(words) // span) - 1)
        for b in range(blocks):
            block = words[b * span : (b + 2) * span]
            shared = len(wanted & set(block))
            if shared >= round(threshold * len(wanted), 9):
                matches.append((b * span, t, label, len(block), shared / len(wanted)))
    labels = {label for _, label in places} | {m[2] for m in matches}
    at = [k for k, _ in places]
    score = 1.0 if at else max((m[4] for m in matches), default=0.0)
    return (
        len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places})),
        ",".join(sorted(labels)), score, sorted(matches),
    )


def _texts():
    """Texts made of template words, so that blocks are near the threshold, and whole, cut and changed templates."""
    rng = random.Random(3)
    pool = [w for _, t in TEMPLATES for w in t.split()]
    out = [None, "", " \t", "MIT-license!", "mit license" * 3, "the MIT License", "apache", "license", "général public license"]
    for _ in range(120):
        words = [rng.choice([*pool, "Wort", "straße", "x"]) for _ in range(rng.choice([3, 20, 200]))]
        for _ in range(rng.randrange(3)):
            template = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                template[rng.randrange(len(template))] = rng.choice(["other", "the"])
            at = rng.randrange(len(words))
            words[at:at] = template
        out.append(rng.choice([" ", "\n", ", "]).join(words))
    return out


@pytest.mark.parametrize("threshold", [0.6, 0.9, 1.0])
def test_every_block_that_meets_a_template(spark, threshold):
    texts = _texts()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in scan_licenses(table, threshold=threshold).collect()}
    assert len(found) == len(texts)
    pairs = 0
    for k, text in enumerate(texts):
        r = found[k]
        matches = sorted((m.first_word, m.template, m.label, m.n_words, m.containment) for m in r.matches)
        mine = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, matches)
        assert mine == _brute(text, TEMPLATES, PHRASES, threshold), text
        pairs += len(matches)
    assert pairs > 30


def test_own_templates_and_odd_rows(spark, odd, empty):
    own = [("german", "Der Hund und die Katze liegen"), ("tiny", "two")]
    found = scan_licenses(odd, templates=own, phrases=[("dogs", "the dog and the cat")]).collect()
    assert len(found) == odd.count()
    for r in found:
        if r.doc_id in (8, 9):
            assert (r.labels, r.base_labels, r.score) == ("german", "", 1.0)
        if r.doc_id in (11, 12):
            assert r.labels == "tiny"
        if r.doc_id == 10:
            assert (r.base_labels, r.n_base, r.first_word) == ("dogs", 3, 0)
        if r.doc_id in (4, 5, 6, 7):
            assert (r.n_base, r.first_word, r.labels, r.score, r.matches) == (0, None, "", 0.0, [])
    assert scan_licenses(empty).count() == 0
    with pytest.raises(ValueError, match="without words"):
        scan_licenses(odd, templates=[("none", "...")])


def test_statements_of_the_table(spark, sf):
    """Every planted statement is found, also the one that no base phrase covers."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: r for r in scan_licenses(table).collect()}
    for r in table.collect():
        expected = _brute(r.text, TEMPLATES, PHRASES, 0.9)
        got = found[r.doc_id]
        assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels, got.labels) == expected[:6]
        assert ("cc-by-nc" in got.labels.split(",")) >= ("Licensed under CC BY-NC 4.0" in (r.text or ""))


def test_words_of_slices():
    texts = pa.array(["skip", "A b2-c\x00d", None, "", "É_é", "x"]).slice(1)
    words, starts = split_words(texts)
    assert words.to_pylist() == ["a", "b2", "c", "d", "É", "é", "x"]
    assert starts.tolist() == [0, 4, 4, 4, 6, 7]
