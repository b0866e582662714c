import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from veridra.llm.chat import INSTRUCT, Marks, Reader, Template, chat_segments, read_back
from veridra.llm.queries import oracle_sql, queries

D = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string"
TRICKY = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\INST]\\", "\\", "[[INST]]", "<s", "</s", "[/INST", "[", "<<s>s>", "<\\/s>", "[ROLE]x[/ROLE]y[/TURN]", "", "a\nb\r\n", "🙂\u2028é", "[SYS]" * 50, "[" + "\\" * 500 + "SYS]"]


def rows_of(spark, conversations):
    return spark.createDataFrame([(c, t, r, x) for c, turns in conversations.items() for t, (r, x) in enumerate(turns)], KIND)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escaping_is_reversible_and_leaves_no_mark():
    random.seed(5)
    parts = [*INSTRUCT.marks, *"\\[]<>/sx ", "INST]", "/s>", "[\\", "<\\"]
    texts = TRICKY + ["".join(random.choices(parts, k=random.randint(1, 12))) for _ in range(20_000)]
    for text in texts:
        safe = INSTRUCT.escape(text)
        assert INSTRUCT.unescape(safe) == text
        assert not INSTRUCT.control.search(safe)
        for m in INSTRUCT.marks:  # nor does one arise where a text meets a mark
            assert [x.span() for x in INSTRUCT.control.finditer(m + safe + m)] == [(0, len(m)), (len(m) + len(safe), len(m) * 2 + len(safe))]


def test_turns_and_learned_text_come_back(spark):
    random.seed(6)
    roles = ["system", "user", "assistant", "tool", "", "</s>", None]
    convs = {i: [(random.choice(roles), random.choice([*TRICKY, None])) for _ in range(random.randint(1, 9))] for i in range(150)}
    convs[None] = [("user", "x"), ("assistant", "[INST]")]
    got = {r.conv_id: r for r in read_back(chat_segments(rows_of(spark, convs).repartition(3))).collect()}
    assert set(got) == set(convs)
    for i, turns in convs.items():
        said = [(r or "", x or "") for r, x in turns]
        learned = "".join(x for r, x in said if r == "assistant")
        allowed = {("begin", "system"), ("begin", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
        good = 0
        for before, (now, _) in zip(["begin", *(r for r, _ in said)], said):
            if (before, now) not in allowed:
                break
            good += 1
        want = (len(said), sha("".join(f"{r}\n{x}\n" for r, x in said)), len(learned), sha(learned), good)
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256, got[i].n_in_order) == want


def test_segments_join_to_the_formatted_text(spark):
    convs = {7: [("system", "be"), ("user", "a[INST]"), ("assistant", "b</s>"), ("user", None), ("user", "c")]}
    segments = chat_segments(rows_of(spark, convs)).orderBy("position").collect()
    text = "".join(s.text for s in segments)
    assert text == "[SYS]be[/SYS][INST]a[\\INST][/INST]<s>b<\\/s></s>[INST][/INST][INST]c[/INST]"
    assert [text[s.start : s.start + len(s.text)] for s in segments] == [s.text for s in segments]
    assert [s.text for s in segments if s.loss] == ["b<\\/s>"]
    assert [s.in_order for s in segments] == [True] * 12 + [False] * 3


def test_a_template_may_learn_the_end_of_turns_and_is_checked(spark):
    roles = {"q": Marks("<q>", "</q>"), "a": Marks("<a>", "</a>", loss=True, loss_tail=True)}
    other = Template(roles, ("<r>", "</r>", "</t>"), {"begin": {"q": "q"}, "q": {"a": "begin"}})
    got = read_back(chat_segments(rows_of(spark, {1: [("q", "x"), ("a", "y<a>")]}), other), other).first()
    assert (got.n_turns, got.loss_chars, got.loss_sha256, got.n_in_order) == (2, 8, sha("y<a></a>"), 2)
    with pytest.raises(ValueError):
        Template({"q": Marks("<q>", "<q>")}, ("<r>", "</r>", "</t>"), {"begin": {}})
    with pytest.raises(ValueError):
        Template({"q": Marks("q:", "</q>")}, ("<r>", "</r>", "</t>"), {"begin": {}})
    with pytest.raises(ValueError):
        Template(roles, ("<r>", "</r>", "</t>"), {"begin": {"q": "nowhere"}})


def test_a_reader_refuses_what_the_template_does_not_write():
    for pieces in (["[INST]a"], ["a[INST]b[/INST]"], ["[INST]a</s>"], ["[/INST]"], ["[ROLE]a[/TURN]"]):
        reader = Reader(INSTRUCT)
        with pytest.raises(ValueError):
            for p in pieces:
                reader.feed(p, False)
            reader.end()


def test_long_conversations_repeated_rows_and_empty_tables(spark):
    assert chat_segments(spark.createDataFrame([], KIND)).count() == 0
    assert read_back(chat_segments(spark.createDataFrame([], KIND))).count() == 0
    long = spark.range(30_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("word " * 40).alias("text"))
    row = read_back(chat_segments(long)).first()
    assert (row.n_turns, row.n_in_order, row.loss_chars, row.formatted_chars) == (30_000, 30_000, 15_000 * 200, 30_000 * 200 + 15_000 * 20)
    big = "[INST]" * 200_000
    twice = spark.createDataFrame([(1, 0, "user", big, 3, "z")] * 2 + [(1, None, None, None, 3, "z")], KIND + ", position int, START string")
    row = read_back(chat_segments(twice)).first()
    assert (row.n_turns, row.turns_sha256, row.n_in_order) == (3, sha("\n\n" + f"user\n{big}\n" * 2), 0)


def test_the_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{D}/conversations.parquet'")
    want = con.sql(oracle_sql()["op11_chat_format"])
    df = queries()["op11_chat_format"](spark, D)
    assert sorted(tuple(r) for r in df.select(*want.columns).collect()) == sorted(want.fetchall())
    assert sorted(df.columns) == sorted(want.columns)
    assert re.fullmatch("[0-9a-f]{64}", df.filter("conv_id = -1").first().turns_sha256)
