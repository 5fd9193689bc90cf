"""Launcher of the batch summary: ``spark-submit submit_summary.py --input ... --output ... --roster ...``."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tricklens.plans.job import main  # noqa: E402

if __name__ == "__main__":
    main()
