"""Two-stage annotation by a pluggable language-model backend: prompts, answer grammars, the two chained calls.

No model is shipped: StubBackend answers from simple rules and proves the plumbing only. GgufBackend runs a model file that
lies in a local folder, through llama_cpp where that is installed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import partial
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.functions.polarity import FOR, any_of
from reportlake.schema import LABELS


@dataclass(frozen=True)
class Sampling:
    """Options of a call. fixed values: the defaults."""

    temperature: float = 0.0
    top_k: int | None = 40
    top_p: float | None = 0.95
    max_tokens: int = 3000
    stop: tuple[str, ...] | None = None
    context: int = 4096


CLASSIFY = "\n".join(
    [
        "You are given one EEG report. For each question give a whole number: 1 = confident no, 2 = uncertain no, 3 = uncertain yes, 4 = confident yes. Prefer 1 and 4.",
        *(f"- {key}: does the report describe {label.replace('Epi', 'epileptiform activity').replace('Non-epi', 'non-epileptiform activity') if label != 'Abnormality' else 'any deviation from a normal EEG'}?" for key, label in LABELS.items()),
        "If any of the first four is 3 or 4, abnormality must be 3 or 4; if none is, it must be 1 or 2.",
        "Answer with one JSON object that has exactly these five keys in this order and nothing else.",
    ]
)
EXPLAIN = "\n".join(
    [
        "You are given one EEG report and a JSON object with five decisions about it.",
        'Answer with one JSON object with the same five keys in the same order. Each value is {"decision": the given number, "reasons": [phrases copied word for word from the report that support it]}.',
        "Escape double quotes inside phrases. Answer with nothing else.",
    ]
)


def classify_prompt(report: Column, template: str = CLASSIFY) -> Column:
    return F.concat(F.lit(template), F.lit("\n\n"), report)


def explain_prompt(report: Column, answer: Column, template: str = EXPLAIN) -> Column:
    """The second call's prompt holds the first call's answer as it came."""
    return F.concat(F.lit(template), F.lit("\n\n"), report, F.lit("\n\n"), answer)


def _grammar(value: str) -> str:
    ws, keys = r"[ \t\n]*", list(LABELS)
    parts = [f'{ws}"{k}":{ws}{value}' for k in keys]
    return r"\A\{" + ",".join(parts[:-1]) + ("," if "reasons" in value else ", ") + parts[-1] + r"\}\z"


def _entry() -> str:
    ws, text = r"[ \t\n]*", r'"[^"]*"'
    listed = rf"(?:\[{ws}\]|\[{ws}{text}(?:,{ws}{text})*{ws}\])"
    return rf'\{{{ws}"decision":{ws}[1-4],{ws}"reasons":{ws}{listed}\}}'


#: Grammars of the two answers as patterns: five keys in order; a blank must follow the comma before the last key of the first.
CLASSIFY_GRAMMAR, EXPLAIN_GRAMMAR = _grammar("[1-4]"), _grammar(_entry())


def is_classification(answer: Column) -> Column:
    return F.rlike(answer, F.lit(CLASSIFY_GRAMMAR))


def is_explanation(answer: Column) -> Column:
    return F.rlike(answer, F.lit(EXPLAIN_GRAMMAR))


class Backend:
    """A model that answers prompts; one is built in each Python worker."""

    def __init__(self, folder: str | None = None):
        self.folder = folder

    def tokens(self, prompt: str) -> int:
        """Length of a prompt in tokens, about."""
        return -(-len(prompt) // 4)

    def answer(self, prompt: str, sampling: Sampling, grammar: str) -> str:
        raise NotImplementedError


class StubBackend(Backend):
    """Answers from the report's words and length alone, in the grammar's form."""

    def __init__(self, folder: str | None = None):
        super().__init__(folder)
        self.finding, self.last = re.compile(any_of(FOR), re.ASCII), (None, None)

    def found(self, report: str) -> str | None:
        """The first finding; both calls about a report ask for it."""
        if self.last[0] != report:
            m = self.finding.search(report.lower())
            self.last = report, m.group() if m else None
        return self.last[1]

    def answer(self, prompt: str, sampling: Sampling, grammar: str) -> str:
        report = prompt.split("\n\n", 1)[1]
        explain = grammar == EXPLAIN_GRAMMAR
        if explain:
            report, _, told = report.rpartition("\n\n")
        found = self.found(report)
        four = [4 if found and (len(report) >> i) & 1 else 1 for i in range(4)]
        if not explain:
            return "{" + ", ".join(f'"{k}": {d}' for k, d in zip(LABELS, [*four, max(four)], strict=True)) + "}"
        told = json.loads(told)
        reason = (found or report[:40]).replace('"', "'").replace("\n", " ").replace("\\", "/")
        return json.dumps({k: {"decision": told[k], "reasons": [reason]} for k in LABELS}, ensure_ascii=False)


class GgufBackend(Backend):
    """A model file in `folder`, run by llama_cpp with the grammar as a constraint."""

    def __init__(self, folder: str | None = None, file: str = "model.gguf"):
        super().__init__(folder)
        path = Path(folder or ".", file)
        if not path.exists():
            raise FileNotFoundError(f"no model file {path}; put it there, this engine downloads nothing")
        try:
            import llama_cpp
        except ImportError as e:
            raise RuntimeError(f"{path} needs the package llama_cpp on every worker") from e
        # fixed values: context and layers on the GPU
        self.llm, self.grammar = llama_cpp.Llama(model_path=str(path), n_ctx=Sampling.context, n_gpu_layers=30, verbose=False), llama_cpp.LlamaGrammar.from_string

    def tokens(self, prompt: str) -> int:
        return len(self.llm.tokenize(prompt.encode()))

    def answer(self, prompt: str, sampling: Sampling, grammar: str) -> str:
        options = {k: v for k, v in (("top_k", sampling.top_k), ("top_p", sampling.top_p), ("stop", sampling.stop)) if v is not None}
        told = self.llm(prompt, grammar=self.grammar(GBNF[grammar]), temperature=sampling.temperature, max_tokens=sampling.max_tokens, **options)
        return told["choices"][0]["text"]


def _gbnf(value: str, rules: str, blank: str) -> str:
    """A grammar in llama_cpp's notation: five keys in order; `blank` follows the last comma."""
    keys = [f'ws "\\"{k}\\":" ws {value}' for k in LABELS]
    return 'root ::= "{" ' + ' "," '.join(keys[:-1]) + f' ",{blank}" {keys[-1]} "}}"\n{rules}ws ::= [ \\t\\n]*\n'


_ENTRY_RULES = (
    'entry ::= "{" ws "\\"decision\\":" ws level "," ws "\\"reasons\\":" ws list "}"\n'
    'list ::= "[" ws "]" | "[" ws text ("," ws text)* ws "]"\ntext ::= "\\"" [^"]* "\\""\nlevel ::= [1-4]\n'
)
#: The same two grammars as GBNF, by their pattern.
GBNF = {CLASSIFY_GRAMMAR: _gbnf("level", "level ::= [1-4]\n", " "), EXPLAIN_GRAMMAR: _gbnf("entry", _ENTRY_RULES, "")}

# fixed values: names of models and their files
GGUF = {
    "mistral": "mistral-7b-instruct-v0.2.Q5_K_M.gguf",
    "deepseek": "deepseek-llm-7b-base.Q5_K_M.gguf",
    "deepseek-chat": "deepseek-llm-7b-chat.Q5_K_M.gguf",
    "hermes-mistral": "nous-hermes-2-mistral-7b-dpo.Q5_K_M.gguf",
    "hermes-llama2": "nous-hermes-llama-2-7b.Q5_K_M.gguf",
}
#: Models by name, each made from the folder of model files; a program may add its own.
BACKENDS: dict[str, Callable[[str | None], Backend]] = {"stub": StubBackend} | {name: partial(GgufBackend, file=file) for name, file in GGUF.items()}
#: Tokens that an answer must have room for.
ROOM = 256


def available() -> list[str]:
    return sorted(BACKENDS)


_built: dict[tuple, Backend] = {}


def maker(name: str) -> Callable[[str | None], Backend]:
    if name not in BACKENDS:
        raise ValueError(f"unknown model {name}; available: {', '.join(available())}")
    return BACKENDS[name]


def _once(name: str, folder: str | None, make: Callable[[str | None], Backend]) -> Backend:
    """The one model of a worker."""
    if (name, folder) not in _built:
        _built.clear()
        _built[name, folder] = make(folder)
    return _built[name, folder]


def _asked(llm: Backend, prompt: str, sampling: Sampling, grammar: str) -> tuple[str | None, str | None]:
    """The answer to a prompt and what is wrong with it. The context's room bounds the answer; without room nothing is sent."""
    room = sampling.context - llm.tokens(prompt)
    if room < ROOM:
        return None, f"prompt leaves {room} of {sampling.context} tokens"
    told = llm.answer(prompt, replace(sampling, max_tokens=min(sampling.max_tokens, room)), grammar)
    return told, None if re.fullmatch(grammar[2:-2], told) else "answer breaks its grammar"


def answered(reports: DataFrame, model: str = "stub", sampling: Sampling | None = None, classify: str = CLASSIFY, explain: str = EXPLAIN, folder: str | None = None) -> DataFrame:
    """report_id, classifications, explanations, error of reports(report_id, report): two chained calls for each row, a batch at a time.

    A null report is empty. A prompt that leaves no room for an answer is not sent: its answer is null and `error` says so. An answer that breaks its
    grammar stays as it is, and `error` says so too.
    """
    sampling, make = sampling or Sampling(), maker(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        llm = _once(model, folder, make)
        for batch in batches:
            rows = []
            for report in batch["report"]:
                report = report or ""
                first, wrong = _asked(llm, f"{classify}\n\n{report}", sampling, CLASSIFY_GRAMMAR)
                second, also = _asked(llm, f"{explain}\n\n{report}\n\n{first}", sampling, EXPLAIN_GRAMMAR) if first is not None else (None, None)
                told = "; ".join(f"{what}: {e}" for what, e in (("classifications", wrong), ("explanations", also)) if e)
                rows.append((first, second, told or None))
            yield pd.DataFrame(rows, columns=["classifications", "explanations", "error"]).assign(report_id=batch["report_id"].to_numpy())

    return reports.select("report_id", "report").mapInPandas(run, "report_id string, classifications string, explanations string, error string")


def annotated(reports: DataFrame, model: str = "stub", sampling: Sampling | None = None, classify: str = CLASSIFY, explain: str = EXPLAIN, folder: str | None = None) -> DataFrame:
    """answered() without the errors."""
    return answered(reports, model, sampling, classify, explain, folder).drop("error")


def unanswered(answers: DataFrame) -> DataFrame:
    """Rows of answered() with an error, in the form of the table of errors."""
    return answers.where("error IS NOT NULL").select("report_id", F.lit("Annotation").alias("error_type"), F.col("error").alias("error_message"), F.coalesce("explanations", "classifications").alias("problematic_json"))
