"""Array kernels: what happens inside one photo, in numpy.

They know nothing of Spark; `grainsight.operators.detect` runs them over Arrow
batches.  Photos are two-dimensional; results are float32 unless said otherwise.
"""
