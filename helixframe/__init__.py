"""helixframe: genome-interval features, site labels, leak-free splits and
model evaluation as Spark DataFrame jobs.

Every public operator is a plain function DataFrame -> DataFrame (or a Column
expression); nothing is collected to the driver except metric rows.
"""

__version__ = "0.1.0"
