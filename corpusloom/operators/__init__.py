"""Operators from DataFrame to DataFrame: joins with ledgers, statistics, ranks, samples and similarity."""
