"""Plans over tables: de-identification, rehydration and evaluation."""
