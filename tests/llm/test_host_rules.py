import re
from collections import Counter

from llm.helpers import frame, odd_texts

from qaloom.llm import host_rules


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_are_those_of_brute_force(spark):
    texts = odd_texts() + ["a b c a b c a b", "a a a a", "a a a", "x\ny\nx\n \nx", "a b c d e f a b c", "|" * 9, "one\x0btwo\x1cthree"]
    texts += [" ".join("abcd"[(k * k + j) % 4] for k in range(90)) for j in range(4)]
    got = {r.doc_id: r for r in host_rules.document_counts(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(text), text
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_a_bad_host_is_refused_and_a_small_one_is_shrunk(spark):
    good, bad = " ".join(f"w{k}" for k in range(80)), "%$# " * 60 + "x"
    rows = [(k, good, "good") for k in range(60)] + [(k, bad, "bad") for k in range(60)] + [(900, good, "bad"), (901, good, "tiny"), (902, good, None), (902, good, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    judged = {(r.doc_id, r.host): r for r in host_rules.judge(host_rules.document_counts(docs)).collect()}
    assert not judged[900, "bad"].kept and judged[900, "bad"].host_failed and not judged[900, "bad"].base_failed
    assert judged[901, "tiny"].kept and judged[902, None].kept and judged[3, "good"].kept
    assert judged[3, "good"].host_rate < judged[901, "tiny"].host_rate < judged[900, "bad"].host_rate
    assert host_rules.judge(host_rules.document_counts(docs.limit(0))).count() == 0
    assert len(host_rules.judge(host_rules.document_counts(docs)).collect()) == len(rows)
