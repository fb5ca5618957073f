"""Compositions of operators: the study population, the analysis, the plan document."""
