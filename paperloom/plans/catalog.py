"""All query modules of the core, and the flagship."""

from __future__ import annotations

from paperloom.plans import files, general, matching, parsing

MODULES = [general, matching, parsing, files]
flagship = matching.rank_top5
