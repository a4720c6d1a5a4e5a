"""Class scores held in arrays."""

from pyspark.sql import Column, functions as F

from defectloom.functions.bind import bind


def add_log_weights(logits, weights) -> Column:
    """Shift every logit by the logarithm of its class weight."""
    prior = F.array(*[F.log(F.lit(float(w))) for w in weights])
    return F.zip_with(logits, prior, lambda z, b: z + b)


def softmax(logits) -> Column:
    def powers(values):
        return bind(
            F.array_max(values), lambda top: F.transform(values, lambda z: F.exp(z - top))
        )

    def normalised(exps):
        total = F.aggregate(exps, F.lit(0.0), lambda s, e: s + e)
        return bind(total, lambda t: F.transform(exps, lambda e: e / t))

    return bind(bind(logits, powers), normalised)


def argmax(values) -> Column:
    """0-based place of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
