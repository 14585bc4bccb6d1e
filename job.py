"""Entry point for ``spark-submit job.py batch|stream ...``."""

from tillflow.cli import main

if __name__ == "__main__":
    main()
