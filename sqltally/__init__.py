"""sqltally: evaluation of SQL answer workloads as Spark jobs.

Subpackages:

* ``sources``   readers and writers of questions, predictions, gold files, logs
* ``functions`` column expressions: response cleaning, canonical cells
* ``operators`` profiling, schema text, prompts, generation, workload
                execution, fingerprints, comparison, voting, metrics
* ``plans``     end-to-end flows and the mapping of the given tables
* ``streaming`` incremental forms of cleaning, accuracy and vote counting
"""

__version__ = "0.3.0"
