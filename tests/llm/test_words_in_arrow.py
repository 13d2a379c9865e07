"""Words of texts numbered by Arrow: scores of the language model, ids of texts."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from sheetspark.llm import maxent, tokens


def test_numbered_words_are_those_of_a_plain_split():
    rnd = random.Random(4)
    letters = "aAbÉéİſß中 \t\n\x0b\x0c\r\x00\x1c\x85\xa0 .-"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(500)]
    texts += [None, "", " ", "a", " a", "a ", None, "x" * 5000 + " y"]
    plain = [(t or "").encode().lower().split() for t in texts]
    whole = pa.array(texts, pa.string())
    for first, last in ((0, len(texts)), (7, 300), (499, len(texts)), (500, 503), (3, 3)):
        for given in (whole[first:last], pa.chunked_array([whole[first : (first + last) // 2], whole[(first + last) // 2 : last]])):
            words, numbers, lengths = maxent.words_in(given)
            listed = words.to_pylist()
            assert len(set(listed)) == len(listed)
            assert lengths.tolist() == [len(p) for p in plain[first:last]]
            assert [listed[n - 1] for n in numbers] == [w for p in plain[first:last] for w in p]


def test_runs_part_no_text():
    lengths = np.array([3, 0, 9, 50, 1, 1, 0])
    for most in (1, 4, 10, 1000):
        found = list(maxent.runs(lengths, most))
        assert [i for run in found for i in range(len(lengths))[run]] == list(range(len(lengths)))
    assert list(maxent.runs(lengths[:0], 4)) == []


def test_scores_of_texts_that_are_not_utf8(spark):
    made = "SELECT id AS doc_id, IF(id = 3, CAST(X'61FF622041' AS STRING), concat('a b', CHAR(9), 'c', id)) AS text FROM range(30)"
    rows = {r.doc_id: r for r in maxent.class_scores(spark.sql(made)).collect()}
    expected = brute.base_scores([(i, "a\x01b A" if i == 3 else f"a b\tc{i}") for i in range(30)])
    for key, (held, n, known, train, base) in expected.items():
        r = rows[key]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and np.isfinite(r.score)


def test_ids_of_words_with_marks_and_final_punctuation(monkeypatch):
    monkeypatch.setattr(tokens, "GROUP_BYTES", 3000)
    rnd = random.Random(6)
    letters = "aAzÀÉÖ×ØÞßàé÷öÿŸİ中éÉȨ̂́.,!&#'<|> \n\t\x0b\xa005"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    texts += [None, "", "&&&", "é.", ".é", "É&&&", "×.", "÷,", "中.", "don't.", "a'.", "a.b.", "x <|endoftext|>.", "ö.\n,"]
    words = tokens.WordIds()
    whole = [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)] == whole
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts, 2)] == [ids + [2] for ids in whole]


def test_words_of_letters_skip_the_whole_tokenizer():
    words, exact = tokens.WordIds(), []
    plain = words._exact
    words._exact = lambda word: exact.append(word) or plain(word)
    list(words.encode(["Émenten ieöö. heitlichü&&& ÉTÉ!! oué, abc... Ñosmi"]))
    assert all(not any(c.isalpha() for c in word) for word in exact)
    assert len(words.words) == 12
