"""riskloom: customer churn-risk analytics as Spark DataFrame jobs.

Raw order / line / event tables are turned into one feature row per
customer, cleaned, winsorised and quintile-scored with exact distributed
ranks, scored into risk tiers, kept current with keyed merges, and
summarised for analysts.  Every operator returns a lazy DataFrame so
Catalyst sees the whole plan.
"""

__version__ = "0.1.0"
