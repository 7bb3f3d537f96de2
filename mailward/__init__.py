"""mailward: email-posture analytics and corpus preparation, declared on Spark DataFrames."""
