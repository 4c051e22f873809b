"""skillsift: job-posting / course-directory analytics on Spark.

Landed JSON -> bronze / silver / gold tables, skill tagging by joining word
n-grams to a skill dictionary, and course recommendation for job titles by
TF-IDF cosine similarity. Every operator is a DataFrame -> DataFrame function;
see README.md for the map of modules.
"""

__version__ = "0.1.0"
