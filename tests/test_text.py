import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdex.functions import text as tx
from loomdex.functions.json_repair import repair_object
from loomdex.functions.lexemes import lexeme_of, weight_table
from loomdex.functions.pricing import call_cost, prices_from_variables
from loomdex.operators.blocks import normalize_blocks, strip_footers, table_text, text_blocks
from loomdex.operators.chunking import chunk_blocks, table_pieces, text_windows
from loomdex.operators.fulltext import vocabulary


def column(spark, values, fn, schema="x STRING"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, " + schema)
    return [r["y"] for r in frame.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_text(spark):
    texts = ["мощ-\nность", "слева  справа", "ﬁx ­ок", "a\n\n\n\nb", "   x\t\ty \n"]
    assert column(spark, texts, tx.clean_text) == ["мощность", "слева справа", "fix ок", "a\n\nb", "x y"]
    blanks = [" \n", "­ ", "x", "­."]
    assert column(spark, blanks, tx.cleans_to_nothing) == [True, True, False, False]


def test_keys(spark):
    assert column(spark, ["540 Вт", "540  вт.", "1,5 л"], tx.evidence_key) == ["540вт", "540вт", "15л"]
    assert column(spark, ["«А» – (б)-в", "1.5 Л"], tx.normalize_value) == ["абв", "15л"]
    assert column(spark, ["qwen/qwen3.5-9b", "--A--"], tx.price_key) == ["qwen_qwen3_5_9b", "a"]
    assert column(spark, ["Coffee_x.pdf", "fan.pdf", "iron"], tx.family_of) == ["coffee", "fan", "iron"]
    assert column(spark, ["код PMP-540, ABC-1", "xABC-800", "нет"], tx.articul) == ["PMP-540", None, None]
    assert column(spark, ["КеттлПро и МиксерПро", "x"], tx.brand) == ["МиксерПро", None]


def test_paragraphs_and_headings(spark):
    assert column(spark, ["a\n\n b \n\n\n\n", "  "], tx.paragraphs) == [["a", "b"], []]
    cases = {
        "ТЕХНИЧЕСКИЕ ДАННЫЕ": "Технические Данные",
        "DON'T-STOP 3D NOW": "Don'T-Stop 3D Now",
        "Короткая строка": "Короткая строка",
        "Предложение.": "",
        "one two three four five six seven eight": "",
        "x" * 60: "",
    }
    assert column(spark, list(cases), tx.heading) == list(cases.values())
    for source, expected in cases.items():
        if source.isupper() and 3 < len(source) < 80:
            assert source.title() == expected


def test_table_text(spark):
    tables = [
        [["Параметр", "Значение"], ["Мощность", "540 Вт"], ["Цвет"]],
        [["a", "b", "c"], ["1", "", "3"], ["4"]],
        [["only header"]],
        [],
    ]
    got = column(spark, tables, table_text, "x ARRAY<ARRAY<STRING>>")
    assert got == ["Мощность: 540 Вт\nЦвет: ", "a=1; c=3\na=4", "", ""]


def blocks(spark, rows):
    return spark.createDataFrame(rows, "doc_id STRING, page INT, block_no INT, kind STRING, content STRING, section STRING")


def test_footers_need_every_page_and_spare_tables(spark):
    frame = blocks(
        spark,
        [
            ("a", 1, 0, "text", "Intro\nPage 1 of 3", ""),
            ("a", 2, 0, "text", "Body\nPage 2 of 3", ""),
            ("a", 2, 1, "table", "Page 2 of 3", ""),
            ("a", 3, 0, "text", "Page 3 of 3", ""),
            ("b", 1, 0, "text", "Footer", ""),
            ("c", 1, 0, "text", "Footer 1", ""),
            ("c", 2, 0, "table", "t", ""),
        ],
    )
    got = {(r["doc_id"], r["page"], r["block_no"]): r["content"] for r in strip_footers(frame).collect()}
    assert got == {
        ("a", 1, 0): "Intro",
        ("a", 2, 0): "Body",
        ("a", 2, 1): "Page 2 of 3",
        ("b", 1, 0): "Footer",
        ("c", 1, 0): "Footer 1",
        ("c", 2, 0): "t",
    }


def test_chunks_run_through_a_document(spark):
    pages = spark.createDataFrame(
        [("d", 1, "ЗАГОЛОВОК\n\n" + "слово " * 300 + "."), ("d", 2, "Артикул PMP-540 МиксерПро")],
        "doc_id STRING, page INT, text STRING",
    )
    chunks = chunk_blocks(normalize_blocks(text_blocks(pages))).orderBy("ordinal").collect()
    assert [c["ordinal"] for c in chunks] == list(range(len(chunks)))
    assert chunks[0]["metadata"]["section"] == "Заголовок"
    assert chunks[1]["metadata"]["section"] == ""
    assert chunks[-1]["metadata"]["articul"] == "PMP-540"
    assert chunks[-1]["metadata"]["brand"] == "МиксерПро"
    assert len({c["chunk_id"] for c in chunks}) == len(chunks)
    assert all(len(c["text"]) <= 700 for c in chunks)


def windows_by_definition(text, size, overlap):
    if len(text) <= size:
        return [text] if text else []
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            spaces = [i for i in range(start + size // 2, end) if text[i] == " "]
            if spaces and spaces[-1] > start:
                end = spaces[-1]
        out.append(text[start:end].strip())
        if end == len(text):
            break
        start = end - overlap
    return [p for p in out if p]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab я\n", max_size=400), st.integers(20, 60), st.integers(0, 9))
def test_windows_match_their_definition(text, size, overlap):
    assert text_windows(text, size, overlap) == windows_by_definition(text, size, overlap)
    assert all(len(p) <= size for p in text_windows(text, size, overlap))


def test_table_pieces_keep_lines_and_repeat_the_first():
    lines = [f"k{i}: {'v' * 20}" for i in range(6)]
    pieces = table_pieces("\n".join(lines), 50)
    assert pieces[0] == "\n".join(lines[:2])
    assert pieces[1] == "\n".join(lines[2:4])
    assert pieces[2].split("\n") == ["[шапка] " + lines[0], lines[4]]
    kept = [x for p in pieces for x in p.split("\n") if not x.startswith("[шапка]")]
    assert kept == lines
    assert table_pieces("x" * 90, 50) == ["x" * 90]


def test_json_repair():
    assert repair_object('{"a": 1}') == {"a": 1}
    assert repair_object('```json\n{"a": 1}\n```') == {"a": 1}
    assert repair_object('```json\n{"a": 1}') == {"a": 1}
    assert repair_object('```{"a": 1}```') == {"a": 1}
    assert repair_object('before {"a": {"b": 2}} after') == {"a": {"b": 2}}
    assert repair_object("x='1' {'a': 1}") == {"a": 1}
    for bad in ("", None, "plain prose", "[1, 2]", "{'a': 1}", "} {"):
        assert repair_object(bad) is None


@pytest.mark.parametrize(
    ("analyzer", "words"),
    [
        ("russian", {"блендера": "блендер", "мощность": "мощност", "гарантии": "гарант", "важнейшими": "важн",
                     "валился": "вал", "бездонным": "бездон", "красивейший": "красив", "ёлка": "елк", "и": None,
                     "running": "run", "national": "nation", "generalization": "general", "communism": "communism",
                     "happy": "happi", "dying": "die", "agreed": "agre", "hoping": "hope", "the": None, "sky": "sky",
                     "consolations": "consol", "inning": "inning", "2200": "2200",
                     # A longer suffix outside its region hides a shorter one inside.
                     "element": "element", "elements": "element", "replacement": "replac", "relative": "relat"}),
        ("simple", {"Blender": "Blender", "и": "и"}),
    ],
)
def test_lexemes(spark, analyzer, words):
    assert column(spark, list(words), lambda w: lexeme_of(w, analyzer)) == list(words.values())


def test_term_weight_is_the_damped_series():
    table = weight_table()
    got = [table[min(n, len(table)) - 1] for n in (1, 2, 3, 1000)]
    def series(n):
        return sum(1 / j**2 for j in range(1, n + 1))

    expected = [0.1 * series(min(n, 255)) / 1.64493406685 for n in (1, 2, 3, 1000)]
    assert got == pytest.approx(expected, abs=1e-12)
    assert got[0] == pytest.approx(0.0607927, abs=1e-6)


def test_prices(spark):
    table = prices_from_variables(
        {"PRICE_MAIN_INPUT": "1.5", "PRICE_MAIN_OUTPUT": "3", "PRICE_X_INPUT": " ", "OTHER": "1"},
        {"PRICE_QWEN_QWEN3_5_9B_INPUT": "0.0000005", "PRICE_MAIN_OUTPUT": "4"},
    )
    assert table["main"] == {"input": 1.5, "output": 4.0}
    assert table["qwen_qwen3_5_9b"]["output"] == 0.0 and "x" not in table
    frame = spark.createDataFrame(
        [("main", 1_000_000, 1_000_000), ("nobody", 5, 5), ("main", None, 1), ("main", 1, 0)],
        "model STRING, p INT, c INT",
    )
    cost = call_cost(F.col("model"), F.col("p"), F.col("c"), table)
    assert [float(r[0]) for r in frame.select(cost).collect()] == [5.5, 0.0, 0.000004, 0.000002]
    half = {"default": {"input": 0.5, "output": 0.0}}
    rounding = spark.createDataFrame([(1,), (3,), (5,)], "p INT")
    cost = call_cost(F.lit("m"), F.col("p"), F.lit(0), half)
    assert [float(r[0]) for r in rounding.select(cost).collect()] == [0.0, 0.000002, 0.000002]


def test_first_name_of_a_list(spark):
    from loomdex.functions.text import brand
    from loomdex.operators.dictionary import first_in_list

    names = [("beta", 2), ("alpha", 1), ("alphabet", 0), ("b", 9), ("", 0), ("beta", 7), ("ёж", 5), ("twin", 3), ("twin two", 3)]
    texts = ["alpha beta", "alphabet", "the b", "nothing", "", None, "ёж beta", "BETA", "twin two"]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id int, text string, place string")
    listed = spark.createDataFrame(names, "name string, place int")
    got = [r["brand"] for r in first_in_list(frame, listed).orderBy("doc_id").collect()]
    assert got == ["alpha", "alphabet", "b", None, None, None, "beta", None, "twin"]
    order = tuple(n for n, _ in sorted(names, key=lambda x: (x[1], x[0])) if n)
    assert got == [r[0] for r in frame.orderBy("doc_id").select(brand(F.col("text"), order)).collect()]
    assert {r["brand"] for r in first_in_list(frame, listed.limit(0)).collect()} == {None}


def test_words_are_distinct_before_they_are_stemmed(spark):
    chunks = spark.createDataFrame([(1, "running runs the run"), (2, "Runs и бегущие"), (3, None)], "chunk_id long, text string")
    found = vocabulary(chunks)
    wanted = spark.createDataFrame([("run",)], "lexeme string")
    asked = found.join(F.broadcast(wanted), "lexeme", "left_semi")
    assert sorted(r["word"] for r in asked.collect()) == ["run", "running", "runs"]
    assert sorted(r["word"] for r in found.collect()) == ["run", "running", "runs", "бегущие"]
    for df in (found, asked):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Aggregate") :].split("\n", 1)[1]
        assert "regexp_replace" not in below
    # Few bytes, much work: the words are not put into one task.
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
