import pyarrow as pa

from corpusloom.llm.decontaminate import Index


def test_items_with_one_edited_word_are_found():
    items = [[f"w{n}x{i}" for i in range(n)] for n in range(10, 30)]
    index = Index(list(range(len(items))), [" ".join(x) for x in items])
    found = lambda words: [x[1] for x in index.hits(pa.array(["before it " + " ".join(words) + " and after it"]), 0.6, 0.6)]
    for k, x in enumerate(items):
        assert found(x) == [k]
        for i in range(len(x)):
            assert found(x[:i] + ["unknown"] + x[i + 1 :]) == [k], ("replaced", len(x), i)
            assert found(x[:i] + x[i + 1 :]) == [k], ("left out", len(x), i)
            assert found(x[:i] + ["unknown"] + x[i:]) == [k], ("put in", len(x), i)


def test_a_question_without_its_answer_and_scattered_words_are_not_found():
    for n in (10, 14, 20):
        x = [f"w{i}" for i in range(n)]
        index, cut = Index([1], [" ".join(x)]), -(-2 * n // 3)
        assert index.hits(pa.array([" ".join(x[:cut]) + " and no answer to it"]), 0.6, 0.6) == []
        assert index.hits(pa.array([" ".join(f"{a} other" for a in x[::-1])]), 0.6, 0.6) == []
