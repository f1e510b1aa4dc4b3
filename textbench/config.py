"""Registries and experiment defaults.

Everything here is plain data.  The Spark code reads it to build small
broadcast tables (models, strategies) and to drive ``spark.read`` for the
corpora; nothing in this module touches Spark.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the benchmark being reproduced (model names,
# back-end names, dataset column names and label maps, strategy names and
# experiment defaults).  Stated as given, in their original order.
# ---------------------------------------------------------------------------

MODEL_CONFIGS = {
    "Qwen/Qwen2-1.5B-Instruct": {"max_new_tokens": 256, "quantization": "4bit"},
    "CEIA-UFG/Gemma-3-Gaia-PT-BR-4b-it": {"max_new_tokens": 256, "quantization": "4bit"},
    "maritaca-ai/sabia-7b": {"max_new_tokens": 256, "quantization": "4bit"},
    "Qwen/Qwen2-7B-Instruct": {"max_new_tokens": 256, "quantization": "4bit"},
    "meta-llama/Meta-Llama-3-8B-Instruct": {"max_new_tokens": 256, "quantization": "4bit"},
    "lucianosb/boto-9B-it": {"max_new_tokens": 256, "quantization": "4bit"},
}

# model -> name of the model in the local serving back end
BACKEND_MODEL_MAPPING = {
    "Qwen/Qwen2-1.5B-Instruct": "qwen2:1.5b-instruct",
    "CEIA-UFG/Gemma-3-Gaia-PT-BR-4b-it": "brunoconterato/Gemma-3-Gaia-PT-BR-4b-it:f16",
    "maritaca-ai/sabia-7b": "hf.co/TheBloke/sabia-7B-GGUF:latest",
    "Qwen/Qwen2-7B-Instruct": "qwen2:7b-instruct",
    "meta-llama/Meta-Llama-3-8B-Instruct": "llama3:8b-instruct-q8_0",
}

DATASETS = {
    "fakebr": {
        "name": "Fake.Br Corpus",
        "text_column": "text",
        "label_column": "label",
        "label_mapping": {"fake": 1, "true": 0},
    },
    "fakerecogna": {
        "name": "FakeRecogna",
        "text_column": "Noticia",
        "label_column": "Label",
        "label_mapping": {"fake": 1, "real": 0},
    },
}

PROMPTING_STRATEGIES = ["zero_shot", "few_shot", "chain_of_thought"]

# the supervised baseline writes this strategy name into its results
FINE_TUNED_STRATEGY = "fine_tuned"

EXPERIMENT_CONFIG = {
    "test_sample_size": 1000,
    "few_shot_examples": 3,
    "random_seed": 42,
    "generation_params": {
        "max_new_tokens": 256,
        "temperature": 0.1,
        "top_p": 0.9,
        "do_sample": True,
        "repetition_penalty": 1.1,
    },
}

# split of the supervised baseline
TRAINING_CONFIG = {
    "seed": 42,
    "test_size": 0.2,
    # settings of the linear baselines, ours to choose
    "num_features": 1 << 16,
    "max_iterations": 100,
}

# parameter-size bins used by the analysis (right-closed)
PARAM_BIN_EDGES = [0.0, 2.0, 5.0, 10.0, float("inf")]
PARAM_BIN_LABELS = ["< 2B", "2-5B", "5-10B", "> 10B"]

# local file formats tried in this order when a corpus is read from disk
LOCAL_FORMATS = ["csv", "json", "parquet"]

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------


def dataset_config(name: str, registry: dict | None = None) -> dict:
    """Registry lookup; unknown names raise with the list of options."""
    reg = DATASETS if registry is None else registry
    if name not in reg:
        raise ValueError(f"Dataset '{name}' not found. Options: {list(reg)}")
    return reg[name]
