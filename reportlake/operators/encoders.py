"""Text encoders behind one interface: Column of text to Column of array<float>.

No pretrained model is shipped. HashingEncoder is a deterministic stand-in that proves the plumbing; its vectors are
not those of any language model. OnnxEncoder runs a model that lies in a local folder, loaded once in each Python worker.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class TextEncoder:
    """An encoder: dimension, tokens it reads at most (None: all; for models with a fixed context), and a function from texts to a matrix of unit vectors."""

    def __init__(self, dim: int = 64, max_tokens: int | None = None, batch: int = 16):
        self.dim, self.max_tokens, self.batch = dim, max_tokens, batch

    def encode_batch(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def __call__(self, text: Column, parts: str | None = None) -> Column:
        """Vectors of a text, or of each of its parts; null for null. Equal texts of a batch are encoded once."""
        encoder = self

        def vectors(texts: list[str]) -> dict[str, np.ndarray]:
            known = list(dict.fromkeys(texts))
            return {t: v for a in range(0, len(known), encoder.batch) for t, v in zip(known[a : a + encoder.batch], encoder.encode_batch([t or " " for t in known[a : a + encoder.batch]]), strict=True)}

        @F.pandas_udf("array<float>" if parts is None else "array<array<float>>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                if parts is None:
                    found = vectors([t for t in batch if t is not None])
                    yield pd.Series([found[t] if t is not None else None for t in batch], dtype="object")
                else:
                    split = [t.split(parts) if t is not None else None for t in batch]
                    found = vectors([t for s in split if s is not None for t in s])
                    yield pd.Series([[found[t] for t in s] if s is not None else None for s in split], dtype="object")

        return encode(text)


class HashingEncoder(TextEncoder):
    """Signed hashed counts of all words of a text, scaled to length 1: a stand-in, not a language model."""

    def encode_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            words = Counter(t.lower().split())
            h = np.fromiter((crc32(w.encode()) for w in words), np.uint32, len(words))
            n = np.fromiter(words.values(), np.float64, len(words))
            out[i] = np.bincount(h % self.dim, np.where(h >> 31, n, -n), self.dim)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


@lru_cache(2)
def _onnx(folder: str):
    """Session and tokenizer of a folder with model.onnx and tokenizer.json; anything missing is named."""
    for name in ("model.onnx", "tokenizer.json"):
        if not Path(folder, name).exists():
            raise FileNotFoundError(f"no {name} in {folder}; export the model there, this engine downloads nothing")
    import onnxruntime
    from tokenizers import Tokenizer

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    return onnxruntime.InferenceSession(str(Path(folder, "model.onnx")), options, providers=["CPUExecutionProvider"]), Tokenizer.from_file(str(Path(folder, "tokenizer.json")))


class OnnxEncoder(TextEncoder):
    """A transformer in a local folder: the first token's state, or the mean over a text's tokens scaled to length 1."""

    def __init__(self, folder: str, pooling: str = "first", max_tokens: int = 512, batch: int = 16):
        super().__init__(0, max_tokens, batch)
        self.folder, self.pooling = folder, pooling
        _onnx(folder)

    def encode_batch(self, texts: list[str]) -> np.ndarray:
        session, tok = _onnx(self.folder)
        tok.enable_truncation(self.max_tokens)
        tok.enable_padding()
        found = tok.encode_batch(texts)
        given = {"input_ids": [e.ids for e in found], "attention_mask": [e.attention_mask for e in found], "token_type_ids": [e.type_ids for e in found]}
        states = session.run(None, {i.name: np.array(given[i.name], np.int64) for i in session.get_inputs()})[0]
        if self.pooling == "first":
            return states[:, 0]
        mask = np.array(given["attention_mask"], np.float32)[:, :, None]
        mean = (states * mask).sum(1) / np.maximum(mask.sum(1), 1)
        return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


# fixed values: models by name, with their pooling, tokens and batch
MODELS = {"bert_base": ("first", 512, 16), "clinicalbert": ("first", 128, 1), "minilm": ("mean", 256, 16)}


def encoder(name: str, folder: str | None = None, **options) -> TextEncoder:
    """An encoder by name; a model is looked for in a folder of its name under `folder`."""
    if name == "hashing":
        return HashingEncoder(**options)
    if name not in MODELS:
        raise ValueError(f"unknown encoder {name}; known: {', '.join(sorted([*MODELS, 'hashing']))}")
    return OnnxEncoder(str(Path(folder or ".", name)), *MODELS[name], **options)
