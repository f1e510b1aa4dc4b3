"""Hand cases for the scalar functions (parsing, truncation, names, bins)."""

from pyspark.sql import functions as F

from textbench.functions import parsing, prompts, text


def _col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_extract_prediction(spark):
    cases = {
        "Verdadeira": 0, "FALSA.": 1, "A notícia não é falsa.": 1,
        "Passo 1: fonte. Classificação: Verdadeira": 1, "realmente não sei": 0, "É VERÍDICA": 0,
        "DESINFORMAÇÃO": 1, "0": 0, "10": 1, "não sei": -1, "Sim": -1, "": -1,
    }
    got = _col(spark, list(cases), parsing.extract_prediction)
    assert got == list(cases.values())
    assert _col(spark, [None], parsing.extract_prediction) == [-1]


def test_truncate_text(spark):
    cases = {"abcdefghij": "abcdefghij", "abcdefghijk": "abcdefghij...", "abcdefgh ijk": "abcdefgh i...",
             "abcdefghi jkl": "abcdefghi...", "ab cdefghijkl": "ab cdefghi..."}
    assert _col(spark, list(cases), lambda c: text.truncate_text(c, 10)) == list(cases.values())


def test_truncate_matches_python_rule(spark):
    def py(t, m):
        if len(t) <= m:
            return t
        h = t[:m]
        s = h.rfind(" ")
        return (h[:s] if s > m * 0.8 else h) + "..."
    texts = ["a b " * 30, "x" * 50 + " y", "é " * 40 + "ü" * 9, " leading and trailing " * 5]
    for m in (5, 10, 37, 100):
        assert _col(spark, texts, lambda c: text.truncate_text(c, m)) == [py(t, m) for t in texts]


def test_model_parameters_and_bins(spark):
    names = ["Qwen/Qwen2-1.5B-Instruct", "CEIA-UFG/Gemma-3-Gaia-PT-BR-4b-it", "maritaca-ai/sabia-7b",
             "Qwen/Qwen2-7B-Instruct", "meta-llama/Meta-Llama-3-8B-Instruct", "lucianosb/boto-9B-it",
             "neuralmind/bert-base-portuguese-cased"]
    assert _col(spark, names, text.model_parameters) == [1.5, 4.0, 7.0, 7.0, 8.0, 9.0, None]
    vals = [0.0, 1.5, 2.0, 4.0, 5.0, 7.0, 10.0, 10.5, None]
    want = [None, "< 2B", "< 2B", "2-5B", "2-5B", "5-10B", "5-10B", "> 10B", None]
    assert _col(spark, vals, text.parameter_bin, "double") == want


def test_backend_name_normalisation(spark):
    cases = ["hf.co/TheBloke/sabia-7B-GGUF:latest", "https://huggingface.co/TheBloke/sabia-7B-GGUF",
             " Qwen2:7b-Instruct "]
    assert _col(spark, cases, text.normalize_backend_name) == [
        "hf.co/thebloke/sabia-7b-gguf", "hf.co/thebloke/sabia-7b-gguf", "qwen2:7b-instruct"]


def test_clean_prediction(spark):
    df = spark.createDataFrame([(0, -1), (1, -1), (1, 0), (0, None), (1, 1)], "label int, prediction int")
    got = [r[0] for r in df.select(parsing.clean_prediction("prediction", "label")).collect()]
    assert got == [1, 0, 0, 1, 1]
    inv = [r[0] for r in df.select(parsing.is_valid_prediction("prediction")).collect()]
    assert inv == [False, False, True, False, True]


def test_short_name_title_key_argmax(spark):
    assert _col(spark, ["a/b/c", "plain"], text.short_model_name) == ["c", "plain"]
    assert _col(spark, ["chain_of_thought"], text.display_title) == ["Chain Of Thought"]
    df = spark.createDataFrame([("org/m-7B", "zero_shot", "quality")], "m string, s string, d string")
    assert df.select(text.experiment_key("m", "s", "d")).first()[0] == "org_m-7B_zero_shot_quality"
    arr = spark.createDataFrame([([0.1, 0.7, 0.2],), ([0.9, 0.9],)], "a array<double>")
    assert [r[0] for r in arr.select(text.argmax_index("a")).collect()] == [1, 0]


def test_prompt_shapes(spark):
    df = spark.createDataFrame([("Texto {text} aqui", 0)], "text string, label int")
    p = df.select(prompts.build_prompt("text", "zero_shot").alias("p")).first()[0]
    assert p.startswith(prompts.SYSTEM_PROMPT + "\n\n")
    assert "Texto {text} aqui" in p and p.endswith("Classificação:")
    assert prompts.SYSTEM_PROMPT.split("\n")[0].endswith(" ")
    line = df.select(prompts.example_line("text", "label")).first()[0]
    assert line == "Notícia:\nTexto {text} aqui\n\nClassificação: Verdadeira\n---\n"
    msgs = df.select(prompts.chat_messages(F.lit("x")).alias("m")).first()[0]
    assert [m["role"] for m in msgs] == ["system", "user"]
    try:
        prompts.build_prompt("text", "bogus")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_classification_prompt_few_shot(spark):
    docs = spark.createDataFrame([(1, "texto"), (2, "outro")], "doc_id long, text string")
    ex = spark.createDataFrame([("exemplo a", 0, 1), ("exemplo b", 1, 2)], "text string, label int, example_rank int")
    out = prompts.classification_prompt(docs, "few_shot", ex).orderBy("doc_id").collect()
    assert len(out) == 2
    p = out[0]["prompt"]
    assert p.index("exemplo a") < p.index("exemplo b") < p.index("texto")
    assert "Classificação: Verdadeira\n---\nNotícia:\nexemplo b\n\nClassificação: Falsa\n---\n" in p


def test_extract_prediction_word_and_binary_modes(spark):
    word = {"Passo 1: fonte. Classificação: Verdadeira": 1, "Em 2010: Verdadeira": 0, "realmente não sei": -1, "A notícia é REAL.": 0,
            "falsa": 1, "10": -1, "1": 1, "É verídica": 0}
    assert _col(spark, list(word), lambda c: parsing.extract_prediction(c, "word")) == list(word.values())
    binary = {"Sim.": 1, "Não": 0, "não sei": 0, "Simplesmente": -1, "talvez": -1}
    assert _col(spark, list(binary), lambda c: parsing.extract_prediction(c, "binary")) == list(binary.values())
