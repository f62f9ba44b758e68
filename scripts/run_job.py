"""spark-submit launcher for the job entries: ``spark-submit --py-files shelfwise.zip scripts/run_job.py daily ...``."""

from shelfwise.plans.jobs import main

if __name__ == "__main__":
    main()
