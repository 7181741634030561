"""Column functions: identities, splits, codecs of positions and moves, token sequences."""

from sequent.functions.columns import *  # noqa: F403
