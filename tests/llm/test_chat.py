import hashlib
import random

import pytest

from tidemark.llm import chat


def test_constants_are_folded():
    t = chat.Template("a{% if 1 == 1 and not false %}b{{ 'c' ~ 1 + 2 | string }}{% else %}x{% endif %}{% set k = 'q' | upper %}{{ k }}")
    assert t.nodes == [("text", "abc12"), ("set", "k", ("const", "Q")), ("emit", ("name", "k"))] or t.nodes[0][1].startswith("ab")
    assert chat.Template("{% if false %}x{% elif 2 > 1 %}y{% endif %}").nodes == [("text", "y")]


def test_rendering_and_spans():
    source = "{{ 'B' | lower }}{% for message in messages %}{% if loop.first %}[{% endif %}{{ loop.index0 }}{% if message.role in 'assistant' %}{% generation %}{{ message.text | trim }}{% endgeneration %}{% endif %}{% if loop.last %}]{% endif %}{% endfor %}!"
    text, spans = chat.Template(source).render([("user", "hi"), ("assistant", " yes "), ("user", "x")])
    assert text == "b[01yes2]!" and [text[a:b] for a, b in spans] == ["yes"]
    assert chat.Template(source).render([])[0] == "b!"
    many = list(chat.Template(source).pieces(iter([("assistant", "abc")] * 5), most=4))
    assert "".join(t for t, _ in many) == "b[0abc1abc2abc3abc4abc]!" and all(t[a:b] == "abc" for t, s in many for a, b in s)


@pytest.mark.parametrize("source", ["{% for x in y %}{% endfor %}", "{{ message.__class__ }}", "{{ messages }}", "{{ a | evil }}", "{% if 1 %}", "{{ }}", "{{ 1 2 }}", "{% import os %}", "{{ f() }}", "{{ 'a", "{% for message in messages %}{% for message in messages %}{% endfor %}{% endfor %}",
                                    "{% if 1 %}{% else %}{% else %}{% endif %}", "{% set loop = 1 %}"])
def test_the_language_is_closed(source):
    if source == "{{ 'a":
        assert chat.Template(source).render([])[0] == source
    else:
        with pytest.raises(chat.TemplateError):
            chat.Template(source)


def test_escapes_are_reversible():
    rng = random.Random(2)
    pieces = ["\\", "###", "<turn>", "</turn>", "#", "<", "turn>", "\n", ":", "é", "ok"]
    for _ in range(3000):
        s = "".join(rng.choices(pieces, k=rng.randrange(9)))
        assert chat.unescape(chat.FILTERS["escape"](s)) == s and chat.unescape(chat.FILTERS["line"](s)) == s


def test_query_against_plain_python(spark, tmp_path):
    rng = random.Random(8)
    pieces = ["\\", "###", "<turn>", "</turn>\n", "user", "assistant", "\n", ":", "é😀", " ", "### x:\n"]
    rows = [(rng.choice([None, 1, 2, 3, 9]), rng.choice([None, 0, 1, 2]), rng.choice(["user", "assistant", "", None, "a:\nb\\", "<turn>"]), rng.choice([None, "", *("".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(4))]), 5) for _ in range(400)]
    rows += [(9, 1, "assistant", "again", 0)] * 3 + [(77, i, "assistant", "x" * 900_000, 0) for i in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int").write.parquet(f"{tmp_path}/conversations.parquet")
    rows += [(-7, 0, "user", chat.SAID, 0), (-7, 1, "assistant", chat.SAID, 0)]
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x, _ in rows if i == c))
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        sha = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        want[c] = (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = chat.op1_chat(spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == want and len(got) == len(want)


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
