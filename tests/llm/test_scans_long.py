from civicspark.llm import scans


def test_a_misread_late_in_a_long_word_is_mended():
    word = "millionilluminationillustrationcollectionqualification" * 2
    model = scans.Model(f"{word}\t50")
    read = word[:-12] + word[-12:].replace("l", "1", 1)
    assert read != word
    fixed = model.corrected(read)
    assert fixed is not None and fixed[1] == word


def test_a_paragraph_of_many_lines_is_one():
    lines = [f"and then line {chr(97 + k % 26)} went on without an end for some more words here" for k in range(200)]
    words = [(w, i) for i, x in enumerate(lines) for w in x.split()]
    assert scans.paragraphs(words, lines, set()) == [" ".join(w for w, _ in words)]
