"""Scorers: cleaned text → logits in label order.

A scorer is the pluggable model. It offers a batch predict function for executors
(``make_predict_fn``, wrapped by ``predict_batch_udf``: the model is loaded once per Python
worker and fed fixed-size Arrow batches inside each partition) and, when the model is simple
enough to be an expression, a Catalyst form (``logits``) that never leaves the JVM.
"""

from __future__ import annotations

from typing import Callable, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CLASSES, DEFAULT_BATCH_SIZE, DEFAULT_MAX_TOKENS


class Scorer(Protocol):
    labels: list[str]
    outputs: str  # "logits" (softmax applied downstream) or "probs" (used as they are)
    pads_batches: bool  # True if a batch costs as much as its longest text (sort by length)

    def make_predict_fn(self) -> Callable[[np.ndarray], np.ndarray]:
        """Load the model (once per worker) and return ``texts[n] -> logits[n, len(labels)]``."""

    def make_counting_fn(self) -> Callable[[np.ndarray], np.ndarray]:
        """As ``make_predict_fn``, with a last column that is 1 where the model reads only part of a text."""

    def logits(self, text: Column) -> Column | None:
        """Catalyst form of the model, or ``None`` if there is none."""


def model_udf(scorer: Scorer, batch_size: int = DEFAULT_BATCH_SIZE, counting: bool = False):
    """The scorer as a vectorised UDF returning ``array<double>`` logits (and whether the text was cut)."""
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(scorer.make_counting_fn if counting else scorer.make_predict_fn,
                             return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)


class LetterScorer:
    """Deterministic test model: logit ``k`` is ``scale`` times the share of ``letters[k]``
    among the characters of the cleaned text."""

    def __init__(self, letters: tuple[str, ...] = ("a", "n", "i"), scale: float = 30.0,
                 labels: list[str] | None = None):
        self.letters = tuple(letters)
        self.scale = float(scale)
        self.labels = list(labels or CLASSES)
        self.outputs = "logits"
        self.pads_batches = False

    def logits(self, text: Column) -> Column:
        # Occurrences of a letter = bytes removed by deleting it / its UTF-8 width: a UTF-8
        # sequence only ever matches at character boundaries, and byte lengths are O(1),
        # while character counts walk the string.
        n = F.length(text).cast("double")
        bytes_ = F.octet_length(text)
        counts = [(bytes_ - F.octet_length(F.replace(text, F.lit(ch), F.lit("")))) / F.lit(len(ch.encode()))
                  for ch in self.letters]
        return F.array(*[F.lit(self.scale) * F.try_divide(c.cast("double"), n) for c in counts])

    def make_counting_fn(self):
        predict = self.make_predict_fn()
        return lambda texts: np.column_stack([predict(texts), np.zeros(len(texts))])  # nothing is cut

    def make_predict_fn(self):
        import pyarrow.compute as pc

        letters, scale = self.letters, self.scale

        def predict(texts: np.ndarray) -> np.ndarray:
            arr = pa.array(texts, type=pa.string())
            n = pc.utf8_length(arr).to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                cols = [scale * (pc.count_substring(arr, ch).to_numpy(zero_copy_only=False)
                                 .astype(np.float64) / n) for ch in letters]
            return np.stack(cols, axis=1)

        return predict


class OnnxScorer:
    """Sequence classifier exported to ONNX, with a ``tokenizers`` JSON tokenizer.

    Texts are truncated to ``max_length`` tokens and padded to the longest in their part of the batch
    (``token_budget``); the first graph output is taken as the logits. Model files are read from ``model_path`` and
    ``tokenizer_path``, which must be readable from every executor. ``threads`` is the
    intra-op thread count of each worker's session: keep it at ``spark.task.cpus`` so
    concurrent tasks on an executor do not oversubscribe its cores. ``providers`` selects the
    execution providers (e.g. CUDA first when executors have GPUs). ``outputs='probs'`` is for
    graphs that end in their own softmax: their values are then used as they are.
    """

    def __init__(self, model_path: str, tokenizer_path: str, labels: list[str] | None = None,
                 max_length: int = DEFAULT_MAX_TOKENS, pad_id: int = 1, threads: int = 1,
                 providers: list[str] | None = None, outputs: str = "logits", token_budget: int = 16_384):
        self.token_budget = token_budget
        self.model_path, self.tokenizer_path = model_path, tokenizer_path
        self.labels = list(labels or CLASSES)
        self.max_length, self.pad_id = max_length, pad_id
        self.threads = threads
        self.providers = list(providers or ["CPUExecutionProvider"])
        self.outputs = outputs
        self.pads_batches = True

    def logits(self, text: Column) -> None:
        return None

    def make_predict_fn(self):
        run = self._session()
        return lambda texts: run(texts)[0]

    def make_counting_fn(self):
        run = self._session()
        return lambda texts: np.column_stack(run(texts))

    def _session(self):
        """texts -> logits, and 1 where a text has more than ``max_length`` tokens. Every text is
        tokenised once; a batch goes through the model in parts of ``token_budget`` padded tokens, texts of
        about one length together, so a long text does not pad all others."""
        import onnxruntime as ort
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(self.tokenizer_path)
        tok.enable_truncation(self.max_length)
        tok.no_padding()
        opts = ort.SessionOptions()
        opts.intra_op_num_threads = self.threads
        opts.inter_op_num_threads = 1
        sess = ort.InferenceSession(self.model_path, sess_options=opts, providers=self.providers)
        wanted = {i.name for i in sess.get_inputs()}

        def run(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            enc = tok.encode_batch([str(t) for t in texts])
            size = np.array([len(e.ids) for e in enc], dtype=np.int64)
            out: np.ndarray | None = None
            for part in token_batches(size, self.token_budget):
                ids = np.full((len(part), max(int(size[part].max()), 1)), self.pad_id, dtype=np.int64)
                mask = np.zeros_like(ids)
                for row, k in enumerate(part):
                    ids[row, :size[k]] = enc[k].ids
                    mask[row, :size[k]] = enc[k].attention_mask
                feeds = {"input_ids": ids, "attention_mask": mask}
                got = np.asarray(sess.run(None, {k: v for k, v in feeds.items() if k in wanted})[0], dtype=np.float64)
                if out is None:
                    out = np.zeros((len(enc), got.shape[1]))
                out[part] = got
            cut = np.array([float(bool(e.overflowing)) for e in enc])
            return (np.zeros((0, len(self.labels))) if out is None else out), cut

        return run


def token_batches(size: np.ndarray, budget: int):
    """Texts in parts, by length: each part's number of texts times its longest is within ``budget``
    (a longer text is a part of its own)."""
    order = np.argsort(size, kind="stable")
    start = 0
    for k in range(1, len(order) + 1):
        if k == len(order) or (k + 1 - start) * int(size[order[k]]) > budget:
            yield order[start:k]
            start = k
