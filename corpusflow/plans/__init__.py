"""Plan shapes shared by the operators."""
from .durable import checkpoint_dir, durable, durable_in_place, in_place, laid_out
from .dims import dimension
from .spread import spread
from .slices import carry_last, lag_in_key, number_in_key, running_sum

__all__ = ["checkpoint_dir", "durable", "durable_in_place", "in_place", "laid_out", "dimension", "spread", "carry_last", "lag_in_key",
           "number_in_key", "running_sum"]
