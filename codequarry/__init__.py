"""codequarry: code-security text analytics and corpus operators on Spark DataFrames."""
