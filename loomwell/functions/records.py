"""Text records of training and evaluation: log lines, checkpoint side files, results, metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fmt import FLOAT_MAX, fixed, scientific

SAMPLE = 100  # characters of a generated text that a log line shows


def _line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _right(x: Column, width: int) -> Column:
    """Padded on the left, never cut."""
    return F.format_string(f"%{width}s", x.cast("string"))


def stamped(seconds: Column, *parts) -> Column:
    return _line("[", _right(seconds, 6), "s] ", *parts)


def step_line(seconds: Column, step: Column, loss: Column, rate: Column, norm: Column) -> Column:
    ppl = _right(fixed(F.exp(loss), 2), 8)
    return stamped(seconds, "Step ", _right(step, 6), " | Loss: ", fixed(loss, 4), " | PPL: ", ppl, " | LR: ", scientific(rate, 2), " | GradNorm: ", fixed(norm, 4))


def eval_line(seconds: Column, step: Column, loss: Column, ppl: Column) -> Column:
    return stamped(seconds, "EVAL Step ", _right(step, 6), " | Loss: ", fixed(loss, 4), " | PPL: ", fixed(ppl, 2))


def checkpoint_line(seconds: Column, step: Column, path: Column) -> Column:
    return stamped(seconds, "CHECKPOINT Step ", step, " -> ", path)


def epoch_line(seconds: Column, epoch: Column) -> Column:
    return stamped(seconds, "=== EPOCH ", epoch, " ===")


def sample_line(seconds: Column, prompt: Column, generated: Column) -> Column:
    return stamped(seconds, 'SAMPLE: "', prompt, '" -> "', F.substring(generated, 1, SAMPLE), '"')


# --- checkpoint side file -----------------------------------------------------------------------------


def meta_text(step: Column, rate: Column, ema: Column, best: Column, norm: Column) -> Column:
    return _line("step=", step, "\nlr=", scientific(rate, 6), "\nema_loss=", fixed(ema, 6), "\nbest_loss=", fixed(best, 6), "\nlast_update_norm=", fixed(norm, 6), "\n")


def _last(text: Column, name: str) -> Column:
    """What follows `name=` on the last line that begins so; null if none does."""
    found = F.filter(F.split(text, "\r?\n"), lambda x: x.startswith(f"{name}="))
    return F.substring(F.get(found, F.size(found) - 1), len(name) + 2, 1 << 30)


def _number(value: Column, form: str, kind: str, bad: Column) -> Column:
    """Null if the line is missing; `bad` if it does not hold a number."""
    return F.when(value.isNull(), F.lit(None)).when(value.rlike(form), F.coalesce(value.try_cast(kind), bad)).otherwise(bad)


def parse_meta(text: Column) -> dict[str, Column]:
    """step, ema_loss, best_loss of a side file; a missing line gives null: the state keeps what it has.

    A line that does not hold a number gives 0, 10 and the largest 32-bit float.
    """
    real = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
    return {
        "step": _number(_last(text, "step"), r"^\+?[0-9]+\z", "bigint", F.lit(0).cast("bigint")),
        "ema_loss": _number(_last(text, "ema_loss"), real, "double", F.lit(10.0)),
        "best_loss": _number(_last(text, "best_loss"), real, "double", F.lit(FLOAT_MAX)),
    }


# --- results and metrics ------------------------------------------------------------------------------


def generation_record(prompt: Column, generated: Column, tokens: Column, size: Column, temperature: Column, top_k: Column) -> Column:
    """One JSON object, names in order of the alphabet; the temperature is a 32-bit float."""
    return F.to_json(F.struct(
        F.concat(prompt, generated).alias("full_text"), generated.alias("generated_text"), size.alias("model_size"), prompt.alias("prompt"),
        temperature.cast("float").cast("double").alias("temperature"), tokens.alias("tokens_generated"), top_k.alias("top_k"),
    ))


def evaluation_text(loss: Column, ppl: Column, tokens: Column) -> Column:
    return _line("Loss: ", fixed(loss, 4), " | PPL: ", fixed(ppl, 2), " | Tokens: ", tokens)


def validation_text(loss: Column, ppl: Column, first: Column, fifth: Column, entropy: Column) -> Column:
    return _line("Loss: ", fixed(loss, 4), " | PPL: ", fixed(ppl, 2), " | Acc@1: ", fixed(first * 100, 2), "% | Acc@5: ", fixed(fifth * 100, 2), "% | H: ", fixed(entropy, 2))
