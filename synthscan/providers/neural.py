"""Neural models as providers: one interface to what a model is run by, batches of like length, statistics in numpy.

A model is a folder or a name. Back ends: `onnx` runs exported graphs with onnxruntime (a folder with model.onnx and
tokenizer.json), `hf` loads transformers models with torch. Either is imported where it is used, in the worker that runs
it; a worker loads a model once on each device it is given.

Texts are scored in batches. A task holds a bounded number of rows, sorts them by token length, cuts them into batches of
at most batch_size texts and CELLS logits, pads and masks each, and gives the rows back in their order. Graphs that take no
mask get padding only where it can't be seen (behind a causal model's tokens); others get texts of equal length together.

Output is packed: a row for each text, an array for each statistic, from one run of each model for everything that is
asked of it. Detectors aggregate the arrays in the row, so nothing is shuffled and no row stands for a token. The long
tables of providers.base are the same arrays, spread.

With GPUs, `gpus` is how many each task of a model's stage gets: a resource profile asks for them, and a task takes the
addresses that Spark gave it. The second of a pair of models goes to the second one.

Defined cases: null and empty texts, and those of a single token, have null arrays; ties in rank share the best one.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from copy import copy
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.perturb import MASK, n_masks
from ..plans.tables import stored
from .base import MASK_MODEL, Provider

# Public model identifiers that detectors use by default.
SCORER, OBSERVER, PERFORMER, SIMILARITY = "gpt2-xl", "tiiuae/falcon-7b", "tiiuae/falcon-7b-instruct", "facebook/bart-large-cnn"
OTHERS = {"fast-detect-gpt": "EleutherAI/gpt-neo-2.7B"}
CAUSAL, SEQUENCE, CLASSIFIER = "causal", "sequence", "classifier"
#: Logits of a batch at most, batches a task holds texts for, and logits that statistics widen to doubles at once.
BATCH, CELLS, HELD, SLICE = 128, 1 << 27, 8, 1 << 22
TOKENS = "logprob array<double>, rank array<long>, mean_lp array<double>, var_lp array<double>"
CROSS = "logprob array<double>, xent array<double>"


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ids as a matrix, zeros behind shorter ones, and which of its cells are ids."""
    width = max(map(len, rows))
    ids, mask = np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        ids[i, : len(row)] = row
        mask[i, : len(row)] = 1
    return ids, mask


class Model:
    """What runs a model: encode, decode, and the logits of a batch."""

    kind: str
    masks: bool
    width: int

    def encode(self, text: str, most: int | None) -> np.ndarray:
        raise NotImplementedError

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def forward(self, ids: np.ndarray, mask: np.ndarray, decoder: np.ndarray | None) -> np.ndarray:
        raise NotImplementedError

    def logits(self, rows: list[np.ndarray], decoders: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Of each row of a batch: a matrix of its own tokens' logits (its decoder's, where there is one), or a classifier's vector."""
        out = self.forward(*padded(rows), None if decoders is None else padded(decoders)[0])
        if self.kind == CLASSIFIER:
            return [x.ravel() for x in out]
        return [x[: len(row)] for x, row in zip(out, decoders or rows, strict=True)]

    def batches(self, rows: list[tuple[np.ndarray, ...]], size: int) -> Iterator[list[int]]:
        """Numbers of rows in batches of like length."""
        alone = not self.masks and self.kind != CAUSAL  # padding would be seen
        lengths = [tuple(map(len, x)) for x in rows]
        batch: list[int] = []
        for i in sorted(range(len(rows)), key=lengths.__getitem__):
            cells = (len(batch) + 1) * max(lengths[i]) * (1 if self.kind == CLASSIFIER else self.width)
            if batch and (len(batch) >= size or cells > CELLS or alone and lengths[i][0] != lengths[batch[0]][0]):
                yield batch
                batch = []
            batch.append(i)
        if batch:
            yield batch


class OnnxModel(Model):
    """An exported graph. Inputs are input_ids and, if the graph has them, attention_mask and decoder_input_ids."""

    def __init__(self, path: str, kind: str, device: str | None = None) -> None:
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # a task has a core
        gpu = device and device.startswith("cuda") and "CUDAExecutionProvider" in onnxruntime.get_available_providers()
        providers = [("CUDAExecutionProvider", {"device_id": int(device.partition(":")[2] or 0)})] if gpu else ["CPUExecutionProvider"]
        self.session = onnxruntime.InferenceSession(os.path.join(path, "model.onnx"), options, providers=providers)
        self.inputs = {x.name for x in self.session.get_inputs()}
        self.tokenizer = Tokenizer.from_file(os.path.join(path, "tokenizer.json"))
        self.kind, self.masks, self.width = kind, "attention_mask" in self.inputs, self.tokenizer.get_vocab_size()

    def encode(self, text: str, most: int | None) -> np.ndarray:
        return np.array(self.tokenizer.encode(text).ids[:most], np.int64)

    def forward(self, ids: np.ndarray, mask: np.ndarray, decoder: np.ndarray | None) -> np.ndarray:
        feed = {"input_ids": ids, "attention_mask": mask, "decoder_input_ids": decoder}
        return np.asarray(self.session.run(None, {k: v for k, v in feed.items() if k in self.inputs and v is not None})[0])


class TorchModel(Model):
    """A transformers model on a device, by default the first GPU, where there is one."""

    masks = True

    def __init__(self, path: str, kind: str, device: str | None = None) -> None:
        import transformers

        from .generate import device as default

        loader = {CAUSAL: "AutoModelForCausalLM", SEQUENCE: "AutoModelForSeq2SeqLM", CLASSIFIER: "AutoModelForSequenceClassification"}[kind]
        self.tokenizer = transformers.AutoTokenizer.from_pretrained(path)
        self.model = getattr(transformers, loader).from_pretrained(path).eval().to(device or default())
        self.kind, self.width = kind, self.model.config.vocab_size

    def encode(self, text: str, most: int | None) -> np.ndarray:
        return np.array(self.tokenizer(text, truncation=most is not None, max_length=most)["input_ids"], np.int64)

    def forward(self, ids: np.ndarray, mask: np.ndarray, decoder: np.ndarray | None) -> np.ndarray:
        import torch

        on = lambda x: torch.tensor(x, device=self.model.device)
        with torch.no_grad():
            out = self.model(input_ids=on(ids), attention_mask=on(mask), **({} if decoder is None else {"decoder_input_ids": on(decoder)}))
        return out.logits.float().cpu().numpy()


@lru_cache(maxsize=4)
def model(backend: str, path: str, kind: str, device: str | None = None) -> Model:
    """One for each Python worker and device."""
    if backend not in ("onnx", "hf"):
        raise ValueError(f"Unknown model backend: {backend!r}. Expected 'onnx' or 'hf'.")
    return (OnnxModel if backend == "onnx" else TorchModel)(path, kind, device)


def devices(n: int) -> list[str | None]:
    """Where the first and the second model of a task go: the GPUs that Spark gave the task, or anywhere if it gave none."""
    from pyspark import TaskContext

    task = TaskContext.get()
    given = task.resources().get("gpu") if task and n else None
    names: list[str | None] = [f"cuda:{x}" for x in given.addresses] if given else [None]
    return [names[0], names[min(1, len(names) - 1)]]


def profile(n: int):
    """The resource profile of stages that run models with n GPUs a task; none without."""
    if not n:
        return None
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(1).resource("gpu", n)).build


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def sliced(of: Callable[..., np.ndarray], *matrices: np.ndarray) -> np.ndarray:
    """of(matrices), a row for each of theirs, with few rows widened to doubles at once."""
    step = max(1, SLICE // max(1, matrices[0].shape[1]))
    return np.concatenate([of(*(np.asarray(x[i : i + step], np.float64) for x in matrices), i) for i in range(0, len(matrices[0]), step)])


def token_statistics(logits: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """Of each token but the first: its log-probability and rank, and mean and variance of log-probabilities there."""
    own = ids[1:]

    def of(x: np.ndarray, first: int) -> np.ndarray:
        lp = log_softmax(x)
        at = lp[np.arange(len(lp)), own[first : first + len(lp)]]
        p = np.exp(lp)
        mean = (p * lp).sum(axis=1)
        return np.stack([at, 1 + (lp > at[:, None]).sum(axis=1), mean, np.maximum((p * lp * lp).sum(axis=1) - mean**2, 0)], axis=1)

    at, rank, mean, var = sliced(of, logits[:-1]).T
    return {"logprob": at, "rank": rank.astype(np.int64), "mean_lp": mean, "var_lp": var}


def cross_entropy(observer: np.ndarray, performer: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    """At each position, of the performer's distribution under the observer's."""
    return sliced(lambda o, p, _: -(np.exp(log_softmax(o / temperature)) * log_softmax(p / temperature)).sum(axis=1), observer, performer)


def drawn_cross_entropy(observer: np.ndarray, performer: np.ndarray, temperature: float, rng: np.random.Generator) -> np.ndarray:
    """The same from one token drawn from the observer at each position."""

    def of(o: np.ndarray, p: np.ndarray, _: int) -> np.ndarray:
        chosen = np.argmax(log_softmax(o / temperature) + rng.gumbel(size=o.shape), axis=1)
        return -log_softmax(p / temperature)[np.arange(len(chosen)), chosen]

    return sliced(of, observer, performer)


def mapped(rows: DataFrame, columns: list[str], schema: str, size: int, start: Callable[[], tuple[Model, Callable, Callable]], gpus: int = 0) -> DataFrame:
    """A row of results, named by schema, for each row, behind row_id and, if there, variant.

    start() gives, in the worker, a model; a function of a row's columns to its arrays of ids, or to None; and a function of
    a batch of them, with its rows' columns, to their results.
    """
    keys = [x for x in ("row_id", "variant") if x in rows.columns]
    kinds = ", ".join(f"{x} {dict(rows.dtypes)[x]}" for x in keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started = None
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal started
            started = started or start()
            engine, prepare, finish = started
            table = pa.Table.from_batches(held)
            values = list(zip(*(table.column(x).to_pylist() for x in columns), strict=True))
            ids = [None if any(v is None for v in x) else prepare(*x) for x in values]
            full = [i for i, x in enumerate(ids) if x is not None]
            out: list[tuple | None] = [None] * len(values)
            for batch in engine.batches([ids[i] for i in full], size):
                at = [full[i] for i in batch]
                for i, found in zip(at, finish([ids[i] for i in at], [values[i] for i in at]), strict=True):
                    out[i] = found
            results = [pa.array([None if x is None else x[j] for x in out], field.type) for j, field in enumerate(types)]
            yield from pa.table([*(table.column(x) for x in keys), *results], names=[*keys, *(f.name for f in types)]).combine_chunks().to_batches()

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                held.append(batch.slice(at, size))
                if sum(x.num_rows for x in held) >= HELD * size:
                    yield from flush()
                    held = []
        if held:
            yield from flush()

    kind = {"array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}
    types = [pa.field(name, kind[t]) for name, t in (x.split(" ") for x in schema.split(", "))]
    return rows.select(*keys, *columns).mapInArrow(run, f"{kinds}, {schema}", profile=profile(gpus))


class NeuralProvider(Provider):
    """Models by name or folder; max_tokens: what scorers and similarity take, cross_tokens: the pair, class_tokens: classifiers
    that are not asked for another number. batch_size: texts a batch at most; gpus: those of a task."""

    packs = True

    def __init__(self, backend: str = "hf", scorer: str = SCORER, observer: str = OBSERVER, performer: str = PERFORMER, similarity: str = SIMILARITY, classifiers: dict[str, str] | None = None, max_tokens: int | None = 1024, cross_tokens: int | None = 512, class_tokens: int | None = 512, batch_size: int = BATCH, gpus: int = 0) -> None:
        self.backend, self.scorer, self.observer, self.performer, self.similarity = backend, scorer, observer, performer, similarity
        self.classifiers, self.max_tokens, self.cross_tokens, self.class_tokens = classifiers or {}, max_tokens, cross_tokens, class_tokens
        self.batch_size, self.gpus = batch_size, gpus

    def of(self, detector: str) -> NeuralProvider:
        if self.backend != "hf" or self.scorer != SCORER or detector not in OTHERS:
            return self
        other = copy(self)
        other.scorer = OTHERS[detector]
        return other

    def key(self, kind: str) -> tuple:
        return (self.backend, *((self.scorer, self.max_tokens) if kind == "tokens" else (self.observer, self.performer, self.cross_tokens)))

    def packed_scores(self, texts: DataFrame) -> DataFrame:
        backend, path, most, gpus = self.backend, self.scorer, self.max_tokens, self.gpus

        def start():
            m = model(backend, path, CAUSAL, devices(gpus)[0])

            def prepare(text: str):
                ids = m.encode(text, most)
                return (ids,) if len(ids) > 1 else None

            def finish(batch, _):
                for (ids,), logits in zip(batch, m.logits([x for x, in batch]), strict=True):
                    yield tuple(token_statistics(logits, ids).values())

            return m, prepare, finish

        return mapped(texts, ["text"], TOKENS, self.batch_size, start, gpus)

    def packed_cross_scores(self, texts: DataFrame, temperature: float | None = None, seed: int = 0) -> DataFrame:
        backend, first, second, most, gpus = self.backend, self.observer, self.performer, self.cross_tokens, self.gpus

        def start():
            on = devices(gpus)
            observer, performer = model(backend, first, CAUSAL, on[0]), model(backend, second, CAUSAL, on[1])

            def prepare(text: str):
                ids = observer.encode(text, most)
                return (ids,) if len(ids) > 1 else None

            def finish(batch, values):
                rows = [x for x, in batch]
                for ids, (text,), o, p in zip(rows, values, observer.logits(rows), performer.logits(rows), strict=True):
                    drawn = temperature is not None
                    xent = drawn_cross_entropy(o, p, temperature, np.random.default_rng([seed, crc32(text.encode())])) if drawn else cross_entropy(o, p)
                    yield token_statistics(p, ids)["logprob"], xent

            return observer, prepare, finish

        return mapped(texts.drop("variant"), ["text"], CROSS, self.batch_size, start, gpus)

    def packed_sequence_scores(self, pairs: DataFrame) -> DataFrame:
        backend, path, most, gpus = self.backend, self.similarity, self.max_tokens, self.gpus

        def start():
            m = model(backend, path, SEQUENCE, devices(gpus)[0])

            def prepare(source: str, target: str):
                ids, wanted = m.encode(source, most), m.encode(target, most)
                return (ids, wanted) if len(ids) and len(wanted) else None

            def finish(batch, _):
                begun = [np.concatenate((wanted[-1:], wanted[:-1])) for _, wanted in batch]  # decoders of this family begin with the end token
                for (_, wanted), logits in zip(batch, m.logits([x for x, _ in batch], begun), strict=True):
                    yield (sliced(lambda x, i, own=wanted: log_softmax(x)[np.arange(len(x)), own[i : i + len(x)]], logits),)

            return m, prepare, finish

        return mapped(pairs, ["source", "target"], "logprob array<double>", self.batch_size, start, gpus)

    def logits(self, texts: DataFrame, name: str, most: int | None = None) -> DataFrame:
        backend, path, most, gpus = self.backend, self.classifiers.get(name, name), most or self.class_tokens, self.gpus

        def start():
            m = model(backend, path, CLASSIFIER, devices(gpus)[0])
            return m, lambda text: (m.encode(text, most),), lambda batch, _: ((x.astype(np.float64),) for x in m.logits([x for x, in batch]))

        return mapped(texts, ["text"], "logits array<double>", self.batch_size, start, gpus)

    # The same as long tables. What both tables of a pair take is computed once.

    def token_scores(self, texts: DataFrame) -> DataFrame:
        keys = [x for x in ("row_id", "variant") if x in texts.columns]
        return self.packed_scores(texts).select(*keys, F.lit(1).cast("long").alias("n"), F.inline(F.arrays_zip("logprob", "rank", "mean_lp", "var_lp")))

    def cross_scores(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        packed = stored(self.packed_cross_scores(texts), "cross")
        return tuple(packed.select("row_id", F.lit(1).cast("long").alias("n"), F.explode(x).alias(x)) for x in ("logprob", "xent"))

    def sampled_cross_scores(self, texts: DataFrame, temperature: float = 1.0, seed: int = 0) -> DataFrame:
        return self.packed_cross_scores(texts, temperature, seed).select("row_id", F.lit(1).cast("long").alias("n"), F.explode("xent").alias("xent"))

    def sequence_scores(self, pairs: DataFrame) -> DataFrame:
        return self.packed_sequence_scores(pairs).select("row_id", F.explode("logprob").alias("logprob"))


def nucleus(lp: np.ndarray, top_p: float) -> np.ndarray:
    """Log-probabilities with all but the most probable tokens, up to a sum of top_p, at minus infinity; the first of all stays."""
    if top_p >= 1:
        return lp
    order = np.argsort(-lp, axis=-1, kind="stable")
    before = np.cumsum(np.exp(np.take_along_axis(lp, order, -1)), axis=-1) - np.exp(np.take_along_axis(lp, order, -1))
    drop, cut = before >= top_p, np.zeros(lp.shape, bool)
    drop[..., 0] = False
    np.put_along_axis(cut, order, drop, -1)
    return np.where(cut, -np.inf, lp)


class MaskFiller:
    """Fills of masked texts by a sequence model, drawn token by token from a nucleus of top_p; small until it is called.

    A text's fill ends with the mask that follows its last one, which its fills don't need more than, or with `most` tokens.
    Texts are filled in batches of like length. Each text's draws hang on it and the seed alone, not on its batch.
    """

    def __init__(self, path: str | None = None, backend: str = "hf", most: int = 150, seed: int = 0, top_p: float = 1.0, batch_size: int = BATCH, gpus: int = 0) -> None:
        self.path, self.backend, self.most, self.seed, self.top_p = path or MASK_MODEL, backend, most, seed, top_p
        self.batch_size, self.gpus = batch_size, gpus

    def __call__(self, texts: list[str]) -> list[str]:
        m = model(self.backend, self.path, SEQUENCE, devices(self.gpus)[0])
        rows = [(m.encode(text, None),) for text in texts]
        out = [""] * len(texts)
        full = [i for i, (ids,) in enumerate(rows) if len(ids)]
        for batch in m.batches([rows[i] for i in full], self.batch_size):
            at = [full[i] for i in batch]
            for i, ids in zip(at, self._drawn(m, [texts[i] for i in at], [rows[i][0] for i in at]), strict=True):
                out[i] = m.decode(ids)
        return out

    def _drawn(self, m: Model, texts: list[str], rows: list[np.ndarray]) -> list[list[int]]:
        rngs = [np.random.default_rng([self.seed, crc32(text.encode())]) for text in texts]
        stops = [{int(x) for x in m.encode(MASK.format(n_masks(text)), None)[:1]} if n_masks(text) else {int(ids[-1])} for text, ids in zip(texts, rows, strict=True)]
        out: list[list[int]] = [[0] for _ in texts]
        live = list(range(len(texts)))
        for _ in range(self.most):
            if not live:
                break
            found = m.logits([rows[i] for i in live], [np.array(out[i], np.int64) for i in live])
            for i, logits in zip(live, found, strict=True):
                lp = nucleus(log_softmax(np.asarray(logits[-1], np.float64)), self.top_p)
                out[i].append(int(np.argmax(lp + rngs[i].gumbel(size=len(lp)))))
            live = [i for i in live if out[i][-1] not in stops[i]]
        return [x[1:] for x in out]
