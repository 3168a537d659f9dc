from cohortlens.plans.analyses import ANALYSES, Tables

__all__ = ["ANALYSES", "Tables"]
