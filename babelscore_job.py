"""spark-submit entry point: ``spark-submit --py-files babelscore.zip babelscore_job.py classify|report ...``"""
from babelscore.plans.jobs import main

if __name__ == "__main__":
    main()
