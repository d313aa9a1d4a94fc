"""Linear inverse problems of ultrasound-modulated optical imaging on Spark DataFrames."""
