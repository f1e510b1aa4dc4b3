"""Prompt construction as Column expressions.

Prompts are assembled with ``concat`` of constant pieces and the (truncated)
text, never by substituting a placeholder into already-filled text, so an
example that happens to contain ``{text}`` is kept verbatim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import free_name
from .text import coerce_text, truncate_text

# ---------------------------------------------------------------------------
# FIXED VALUES — prompt texts, byte for byte (note the blank at the end of
# the first system line).  ``{text}`` / ``{examples}`` / ``{label}`` mark
# where the row values go.
# ---------------------------------------------------------------------------

SYSTEM_PROMPT = """Você é um especialista em análise de notícias e detecção de desinformação. 
Sua tarefa é analisar notícias em português brasileiro e classificá-las como verdadeiras ou falsas.
Seja objetivo e baseie sua análise apenas no conteúdo fornecido."""

ZERO_SHOT_TEMPLATE = """Analise a seguinte notícia e classifique-a como "Verdadeira" ou "Falsa".

Notícia:
{text}

Responda apenas com uma palavra: "Verdadeira" ou "Falsa".

Classificação:"""

FEW_SHOT_TEMPLATE = """Analise as notícias a seguir e classifique cada uma como "Verdadeira" ou "Falsa".

{examples}

Agora, classifique a seguinte notícia:

Notícia:
{text}

Responda apenas com uma palavra: "Verdadeira" ou "Falsa".

Classificação:"""

FEW_SHOT_EXAMPLE_TEMPLATE = """Notícia:
{text}

Classificação: {label}
---"""

CHAIN_OF_THOUGHT_STEPS_TEMPLATE = """Analise a seguinte notícia passo a passo para determinar se é verdadeira ou falsa.

Notícia:
{text}

Siga estes passos de análise:
1. Identifique a fonte e credibilidade aparente
2. Verifique se há linguagem sensacionalista ou emocional
3. Analise se as afirmações são verificáveis
4. Considere se há inconsistências lógicas
5. Avalie o tom geral da notícia

Após sua análise, forneça sua classificação final.

Análise:
Passo 1 (Fonte):
Passo 2 (Linguagem):
Passo 3 (Verificabilidade):
Passo 4 (Consistência):
Passo 5 (Tom):

Classificação Final (responda "Verdadeira" ou "Falsa"):"""

CHAIN_OF_THOUGHT_TEMPLATE = """Analise a seguinte notícia e determine se é verdadeira ou falsa.

Notícia:
{text}

Primeiro, explique brevemente seu raciocínio (em 2-3 frases).
Depois, forneça sua classificação final.

Raciocínio:

Classificação Final (responda apenas "Verdadeira" ou "Falsa"):"""

ALTERNATIVE_PROMPTS = {
    "concise": """Classifique como Verdadeira ou Falsa:
{text}
Classificação:""",
    "detailed": """Você é um fact-checker profissional. Analise cuidadosamente a seguinte notícia 
e determine sua veracidade baseado em:
- Uso de linguagem sensacionalista
- Presença de fontes verificáveis
- Consistência interna
- Tom emocional vs. factual

Notícia:
{text}

Sua classificação (Verdadeira/Falsa):""",
    "binary": """Notícia: {text}

Esta notícia é fake news? Responda apenas "Sim" ou "Não".
Resposta:""",
    "confidence": """Analise a notícia abaixo e classifique-a.

Notícia:
{text}

Forneça:
1. Classificação: Verdadeira ou Falsa
2. Confiança: Alta, Média ou Baixa
3. Justificativa breve (1 frase)

Resposta:""",
}

TRUE_LABEL_TEXT = "Verdadeira"
FAKE_LABEL_TEXT = "Falsa"

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------

VALID_STRATEGIES = ["zero_shot", "few_shot", "chain_of_thought"]

# strategy -> template actually used to build prompts
TEMPLATES = {
    "zero_shot": ZERO_SHOT_TEMPLATE,
    "few_shot": FEW_SHOT_TEMPLATE,
    "chain_of_thought": CHAIN_OF_THOUGHT_TEMPLATE,
    "chain_of_thought_steps": CHAIN_OF_THOUGHT_STEPS_TEMPLATE,
    **ALTERNATIVE_PROMPTS,
}


def get_template(strategy: str) -> str:
    """The raw template of a strategy (placeholders unfilled)."""
    if strategy not in TEMPLATES:
        raise ValueError(f"Invalid strategy. Options: {list(TEMPLATES)}")
    return TEMPLATES[strategy]


def registered_strategies() -> list[str]:
    """Every strategy a prompt can be built for: the benchmark's and the extra templates."""
    return list(TEMPLATES)


def check_strategies(strategies: list[str]) -> None:
    unknown = [s for s in strategies if s not in TEMPLATES]
    if unknown:
        raise ValueError(f"Invalid strategy {unknown}. Options: {list(TEMPLATES)}")


def _pieces(template: str) -> list:
    """Template -> list of constant strings and placeholder names."""
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [head, ("ph", name)]
    out.append(rest)
    return out


def fill(template: str, **values: Column) -> Column:
    """``concat`` of the template's constant pieces and the given columns."""
    parts = []
    for p in _pieces(template):
        if isinstance(p, tuple):
            parts.append(values[p[1]])
        elif p:
            parts.append(F.lit(p))
    return F.concat(*parts)


def label_text(label) -> Column:
    lab = F.col(label) if isinstance(label, str) else label
    # examples are drawn from classes 0 and 1; anything else here is a mistake
    return (F.when(lab == 0, F.lit(TRUE_LABEL_TEXT)).when(lab == 1, F.lit(FAKE_LABEL_TEXT))
            .otherwise(F.raise_error(F.lit("an example needs a label of 0 or 1")).cast("string")))


def example_line(text, label, max_text_length: int = 2000) -> Column:
    """One few-shot example block, newline-terminated."""
    t = coerce_text(F.col(text) if isinstance(text, str) else text)
    body = fill(FEW_SHOT_EXAMPLE_TEMPLATE, text=truncate_text(t, max_text_length // 2), label=label_text(label))
    return F.concat(body, F.lit("\n"))


def few_shot_block(examples: DataFrame, order_col: str = "example_rank", by: list | None = None,
                   max_text_length: int = 2000) -> DataFrame:
    """Collapse the (few) example rows of each group into one ordered text
    block: ``by`` columns + ``examples_text``.  Input size is bounded by the
    number of examples per group, so the ordered collect is bounded too."""
    by = by or []
    lines = examples.select(*by, F.col(order_col).alias("_ord"),
                            example_line("text", "label", max_text_length).alias("_line"))
    agg = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_ord", "_line"))), lambda x: x["_line"]), "")
    if by:
        return lines.groupBy(*by).agg(agg.alias("examples_text"), F.count("*").alias("n_examples"))
    return lines.agg(agg.alias("examples_text"), F.count("*").alias("n_examples"))


def build_prompt(text, strategy: str, examples_text=None, max_text_length: int = 2000,
                 use_system_prompt: bool = True) -> Column:
    """Prompt for one fixed strategy."""
    check_strategies([strategy])
    t = truncate_text(coerce_text(F.col(text) if isinstance(text, str) else text), max_text_length)
    if strategy == "few_shot":
        if examples_text is None:
            raise ValueError("Few-shot prompts need examples (examples_text column).")
        ex = F.col(examples_text) if isinstance(examples_text, str) else examples_text
        body = fill(FEW_SHOT_TEMPLATE, examples=ex, text=t)
    else:
        body = fill(get_template(strategy), text=t)
    if use_system_prompt:
        body = F.concat(F.lit(SYSTEM_PROMPT + "\n\n"), body)
    return body


def build_prompt_by_strategy(text, strategy_col="strategy", examples_text="examples_text",
                             max_text_length: int = 2000, use_system_prompt: bool = True) -> Column:
    """Prompt when the strategy is a column: a CASE over the registered
    strategies.  The text is truncated once and shared by all branches.  A
    few-shot row without examples yields NULL (the caller turns that into an
    error), and so does an unknown strategy (:func:`check_strategies` first)."""
    s = F.col(strategy_col) if isinstance(strategy_col, str) else strategy_col
    t = truncate_text(coerce_text(F.col(text) if isinstance(text, str) else text), max_text_length)
    ex = F.col(examples_text) if isinstance(examples_text, str) else examples_text
    body = F.when(s == "few_shot", fill(FEW_SHOT_TEMPLATE, examples=ex, text=t))
    for name in registered_strategies():
        if name != "few_shot":
            body = body.when(s == name, fill(get_template(name), text=t))
    if use_system_prompt:
        body = F.concat(F.lit(SYSTEM_PROMPT + "\n\n"), body)
    return body


def chat_messages(prompt) -> Column:
    """[system, user] message list; the system text is sent separately even
    when the prompt already starts with it."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), p.alias("content")),
    )


def classification_prompt(df: DataFrame, strategy: str = "zero_shot", examples: DataFrame | None = None,
                          max_length: int = 2000, text_col: str = "text") -> DataFrame:
    """Convenience wrapper: add a ``prompt`` column to ``df``.  Few-shot
    examples (a small frame with ``text``, ``label`` and an order column
    ``example_rank``) are collapsed into one block."""
    if strategy == "few_shot":
        if examples is None:
            raise ValueError("Few-shot prompts need examples.")
        # one block (at most the given examples), as a scalar subquery: no join
        block = few_shot_block(examples, max_text_length=max_length).select("examples_text").scalar()
        name = free_name(df.columns, "examples")
        out = df.withColumn(name, block)
        return out.withColumn("prompt", build_prompt(text_col, strategy, name, max_length)).drop(name)
    return df.withColumn("prompt", build_prompt(text_col, strategy, None, max_length))
