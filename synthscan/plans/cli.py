"""Command line: score datasets, or evaluate saved scores."""

from __future__ import annotations

import argparse
import logging
from functools import reduce

from pyspark.sql import functions as F

from .. import __version__
from ..detectors import all_detectors, list_detectors
from ..operators import evaluate
from ..providers.base import Provider, provider
from ..session import session
from ..sources import readers, sinks
from .scoring import score_dataset

log = logging.getLogger(__name__)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="synthscan", description="Score texts for machine authorship.")
    p.add_argument("dataset", nargs="+", help="files (.csv, .jsonl, .json, .parquet, .orc) or hub datasets")
    p.add_argument("--detector", help=f"one of {', '.join(list_detectors())}; all by default")
    p.add_argument("--force", action="store_true", help="score again where scores exist")
    p.add_argument("--text-field", default="text")
    p.add_argument("--label-field", default="label")
    p.add_argument("--machine-label", type=int, default=1)
    p.add_argument("--row-id", help="column with unique row numbers; numbered in order by default")
    p.add_argument("--split", help="of a hub dataset; test by default")
    p.add_argument("--output-dir")
    p.add_argument("--batch-size", type=int, default=128, help="texts a batch for model back ends, at most")
    p.add_argument("--gpus", type=int, default=0, help="GPUs for each task that runs a model; binoculars takes two if there are")
    p.add_argument("--debug", action="store_true", help="the first 100 rows only")
    p.add_argument("--evaluate", action="store_true", help="metrics of saved scores")
    p.add_argument("--provider", choices=["ngram", "hf", "onnx", "tables"], default="ngram", help="where model output comes from")
    p.add_argument("--provider-path", help="folder of exported models (onnx) or of precomputed output (tables)")
    p.add_argument("--mask-model", help="sequence model that fills masks for npr")
    p.add_argument("--mask-backend", choices=["hf", "onnx"], default="hf")
    p.add_argument("--mask-top-p", type=float, default=1.0, help="share of the probability that fills are drawn from")
    p.add_argument("--perturbations", type=int, default=10)
    for name, default in (("reviser", "hf"), ("dna-gpt-regenerator", "hf")):
        p.add_argument(f"--{name}", choices=["hf", "vllm", "openai"], default=default)
        p.add_argument(f"--{name}-model")
    p.add_argument("--vllm-max-model-len", type=int, default=4096)
    p.add_argument("--vllm-gpu-memory-utilization", type=float, default=0.9)
    p.add_argument("--dna-gpt-k", type=int, default=20)
    p.add_argument("--dna-gpt-truncate-ratio", type=float, default=0.5)
    p.add_argument("--dna-gpt-prompt-field")
    p.add_argument("--version", action="version", version=__version__)
    for detector in all_detectors().values():
        detector.add_arguments(p)
    return p


def options(a: argparse.Namespace, provider: Provider | None = None) -> dict[str, dict]:
    """Options of the detectors."""
    def back(kind: str) -> dict:
        own = {"batch_size": a.batch_size}
        return own | ({"max_model_len": a.vllm_max_model_len, "gpu_memory_utilization": a.vllm_gpu_memory_utilization} if kind == "vllm" else {})

    own = {
        "npr": {"fill_model": a.mask_model, "fill_backend": a.mask_backend, "n_perturbations": a.perturbations, "fill_options": {"top_p": a.mask_top_p, "batch_size": a.batch_size, "gpus": a.gpus}},
        "revise-detect": {"backend": a.reviser, "model": a.reviser_model, "backend_options": back(a.reviser)},
        "dna-gpt": {"backend": a.dna_gpt_regenerator, "model": a.dna_gpt_regenerator_model, "k": a.dna_gpt_k, "ratio": a.dna_gpt_truncate_ratio, "prompt": a.dna_gpt_prompt_field, "backend_options": back(a.dna_gpt_regenerator)},
    }
    return {name: own.get(name, {}) | ({"provider": provider} if provider else {}) for name in list_detectors()}


def evaluated(spark, a: argparse.Namespace) -> list[dict]:
    """Prints and returns the metric rows of all datasets."""
    parts = []
    for source in a.dataset:
        path = sinks.scores_path(sinks.output_dir(a.output_dir), sinks.dataset_key(spark, source), a.debug)
        if not readers.exists(spark, f"{path}/export"):
            log.error("No saved scores at %s", path)
            continue
        df = sinks.read_export(spark, f"{path}/export")
        if a.label_field not in df.columns:
            log.error("%s has no column %r", source, a.label_field)
            continue
        names = [d for d in list_detectors() if d in df.columns]
        if names:
            parts.append(evaluate.long_scores(df, names, evaluate.is_machine(F.col(a.label_field), a.machine_label), F.lit(source)))
    if not parts:
        return []
    rows = evaluate.metrics(reduce(lambda x, y: x.union(y), parts)).cache()
    shown = evaluate.displayed(rows)
    print(sinks.markdown(shown))
    if len(a.dataset) > 1:
        print("\nMacro average\n" + sinks.markdown(evaluate.displayed(evaluate.macro_average(rows))))
    return shown


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s [%(name)s] %(levelname)s: %(message)s")
    a = parser().parse_args(argv)
    spark = session()
    if a.evaluate:
        evaluated(spark, a)
        return 0
    own = {"batch_size": a.batch_size, "gpus": a.gpus} if a.provider in ("hf", "onnx") else {}
    models = provider(a.provider, spark, a.provider_path, **own)
    for source in a.dataset:
        score_dataset(spark, source, a.output_dir, a.debug, a.text_field, a.split, a.row_id, detectors=[a.detector] if a.detector else None, force=a.force, options=options(a, models))
    return 0
