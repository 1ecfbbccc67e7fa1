"""Reports on school literacy assessments, written as plain Spark DataFrame plans.

``levelbook.sources``    the twelve input tables and how to open them
``levelbook.functions``  column expressions and the fixed vocabulary of the reports
``levelbook.operators``  general DataFrame -> DataFrame building blocks
``levelbook.plans``      the reports and the summaries computed on them
``levelbook.checks``     the sample mapping of test data and the SQL twins of the queries
"""
