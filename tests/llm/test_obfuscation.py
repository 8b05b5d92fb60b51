"""The gate of the decoder against decoding every word of the text."""

import pytest

from skeinwork.llm import op8_toxicity


@pytest.fixture(scope="module")
def scorer(spark):
    return op8_toxicity.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


def test_gate_is_as_wide_as_the_lattice(spark, scorer):
    model = scorer.log_probs()
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    written = ["stuupid", "idiiot", "1d107", "5h17", "a$$", "shi+", "stu-pid", "st.up.id", "s--tupid", "wow!", "ball", "$cum"]
    for word in {w for t in [*docs, *written] for w in t.split()}:
        core = word.strip(op8_toxicity._EDGES)
        if any(map(str.isalpha, core)) and not op8_toxicity._SPACED_RUN.search(word):
            assert op8_toxicity._WORDS.findall(op8_toxicity.restore(word, model).lower()) == op8_toxicity._WORDS.findall(op8_toxicity.decode(core, model)), word


def test_more_obfuscated_words_are_restored(scorer):
    bad = {}
    for written, word in {
        "stuupid": "stupid", "idiiot": "idiot", "ssttupid": "stupid", "1d107": "idiot", "stu-pid": "stupid", "st.up.id": "stupid", "i  d  i  o  t": "idiot",
        "idio+": "idiot", "!diot": "idiot", "idiot!": "idiot", "$tupid!!": "stupid", "scu--m": "scum", "i\td\ti\to\tt": "idiot",
        "i\u200bd\u200biot": "idiot", "stu\u00adpid": "stupid", "1.D.1.0.+": "idiot",
    }.items():
        text = f"the and {written} of the"
        if word not in scorer.words_of(text) or scorer.score(text) < 0.3:
            bad[written] = op8_toxicity.restore(text, scorer.log_probs())
    assert not bad
    assert scorer.score("A well-known ball at 10:45, wow! It costs $20 or 30% (see a/b and x-y).") < 0.3


def test_words_in_marks_and_numbers(scorer):
    model = scorer.log_probs()
    for word in ("@$$", "4$$", "5!+7"):
        assert op8_toxicity.suspicious_spans(f"the {word} of") == [(4, 4 + len(word))], word
        assert op8_toxicity._WORDS.findall(op8_toxicity.restore(word, model)), word
    for number in ("$20", "10:45", "1,000.50", "30%", "+49", "7/8", "#1", "€5", "5!", "2024-01-02", "100"):
        assert op8_toxicity.suspicious_spans(f"the {number} of") == [], number
