import random

import public_tokenizers
from llm.helpers import frame, odd_texts, rows
from tokenizers import Tokenizer

from qaloom.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_counts_are_those_of_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    letters = list("abcdeE'sStTΣσİß é́ \x1c\x1f\x85\t\n  🙂中文字ไทย0123½²Ⅷ_-=*#.!") + [
        "<|startoftext|>", "<|endoftext|>", "<|", "'ll", "'re", "aaaa", "====", "hello", "ing ", "tion"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(4000)] + odd_texts()
    texts += ["ab" * 2000, "".join(rng.choices("aeilnrst", k=8000))]
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in enumerate(texts)]
    got = token_counts.token_counts(frame(spark, texts), PATH)
    assert rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.token_counts(frame(spark, []), PATH).count() == 0


def test_memory_of_words_may_be_dropped(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    counter = token_counts.Counter(PATH)
    assert counter.count(["one two three four", "five"]) == [4, 1]
    assert counter.count(["one two", None]) == [2, 0]


def test_products_used_by_lower_ranks_are_merged_one_at_a_time():
    merges = token_counts.Merges(PATH)
    before = merges.count([b"mississippi", b"aaaaaaa", b"x"]).tolist()
    merges.at_once[:] = False
    assert merges.count([b"mississippi", b"aaaaaaa", b"x"]).tolist() == before
