"""screenflow: curate, compare, split, model and rank keyed records with Spark."""
