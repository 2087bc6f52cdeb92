"""Matching inputs derived from the driver's tables by plain SQL.

The tables hold no candidate documents, Spanish postings or applications, so
these views put headers, markup and statuses around the whole given texts. The
same SQL runs in Spark and in the checking engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from encaje.session import spread

CVS = """
SELECT concat('cv', doc_id) AS cv_id,
  CASE doc_id % 4
    WHEN 0 THEN concat('INFORMACIÓN PERSONAL Ana ', head, ' ana', doc_id,
      '@ejemplo.es +34 612 345 678 EXPERIENCIA Desarrollador Python ', middle, ' ',
      1 + doc_id % 9, ' años EDUCACIÓN Grado en Informática HABILIDADES python sql spark c++ ',
      'ci/cd IDIOMAS Inglés avanzado PROYECTOS www.ejemplo.es ', rest)
    WHEN 1 THEN concat('PERFIL ', head, ' HABILIDADES java docker node.js EXPERIENCIA Analista ',
      'funcional 2015-2019 ', middle, ' ESTUDIOS Licenciatura en Derecho Universidad Central ',
      'CERTIFICACIONES aws ', rest)
    WHEN 2 THEN concat('Formación: Grado en Estadística Instituto Norte CONOCIMIENTOS python ',
      'pandas IDIOMAS Francés fluido TRABAJOS ', text)
    ELSE text END AS raw_text
FROM (SELECT doc_id, text, substr(text, 1, third) AS head, substr(text, third + 1, third) AS middle,
             substr(text, 2 * third + 1) AS rest
      FROM (SELECT doc_id, text, CAST(floor(length(text) / 3) AS INT) AS third FROM {documents}) t
     ) parts
"""

JOBS = """
SELECT concat('job', page_id) AS job_id,
  CASE page_id % 4
    WHEN 0 THEN replace(html, '<article>', concat(
      '<article><h2 class="job-title">Desarrollador <b>Python</b></h2><div class="empresa">Acme ',
      page_id, '</div><span class="location">Madrid</span><div class="description"><div>Programar ',
      'en python.</div> Uso de docker</div><ul class="requirements"><li>Conocimientos en sql y ',
      'spark.</li><li>Experiencia de 3 años</li></ul><section class="funciones">Tareas diarias',
      '</section><div class="beneficios">Seguro</div>'))
    WHEN 1 THEN replace(html, '<article>', concat(
      '<article><p>Puesto: Analista de datos. Empresa: Beta ', page_id,
      '. Ciudad: Sevilla. Descripción del puesto uso de java Requisitos dominio de sql y react. ',
      'Experiencia mínima 2 años Formación requerida grado. Responsabilidades preparar informes ',
      'Beneficios horario flexible</p>'))
    WHEN 2 THEN replace(html, '<article>', concat(
      '<article><p>Job title: Data engineer. Employer: Gamma. City: Lima. About the job data ',
      'Requirements knowledge of python. Experience 4 years. Degree in bachelor science. ',
      'Benefits remote</p>'))
    ELSE html END AS html
FROM {pages}
"""

# Some ids point at documents or postings that do not exist.
APPLICATIONS = """
SELECT concat('app', doc_id) AS applicationId,
  CASE WHEN doc_id % 17 = 0 THEN concat('cv-gone', doc_id) ELSE concat('cv', doc_id) END
    AS candidateId,
  CASE WHEN doc_id % 19 = 0 THEN concat('job-gone', doc_id)
       ELSE concat('job', doc_id % (SELECT count(*) FROM {pages})) END AS jobId,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'WITHDRAWN'
       WHEN quality = 1 AND toxic = 0
         THEN CASE doc_id % 3 WHEN 0 THEN 'HIRED' WHEN 1 THEN 'accepted' ELSE 'Matched' END
       ELSE CASE doc_id % 3 WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'not_matched' ELSE 'PENDING' END
  END AS applicationStatus
FROM {labels}
"""

PAIRS = """
SELECT candidateId AS cv_id, jobId AS job_id FROM {applications}
UNION ALL SELECT 'cv-none', 'job-none'
"""

CV_PAGES = "SELECT concat('conv', conv_id) AS id, turn AS page_no, text FROM {conversations}"

JOB_PRIORITY = """
SELECT concat('job', page_id) AS job_id, concat('<p>', url, '</p>') AS html
FROM {pages} WHERE url LIKE 'https://m.%'
"""

SCORED = """
SELECT doc_id, quality AS label, CAST(doc_id % 7 AS DOUBLE) / 7 AS match_probability,
       CASE WHEN CAST(doc_id % 7 AS DOUBLE) / 7 > 0.5 THEN 1 ELSE 0 END AS class
FROM {labels}
"""


class Inputs:
    """The driver's tables of one folder and the views on top of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, sql: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(sql, **frames)

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.table("documents"))

    @cached_property
    def pages(self) -> DataFrame:
        return spread(self.table("pages"))

    @cached_property
    def labels(self) -> DataFrame:
        return self.table("labels")

    @cached_property
    def conversations(self) -> DataFrame:
        return self.table("conversations")

    @cached_property
    def cvs(self) -> DataFrame:
        return self._view(CVS, documents=self.documents)

    @cached_property
    def jobs(self) -> DataFrame:
        return self._view(JOBS, pages=self.pages)

    @cached_property
    def applications(self) -> DataFrame:
        return self._view(APPLICATIONS, labels=self.labels, pages=self.table("pages"))

    @cached_property
    def pairs(self) -> DataFrame:
        return self._view(PAIRS, applications=self.applications)

    @cached_property
    def cv_pages(self) -> DataFrame:
        return self._view(CV_PAGES, conversations=self.conversations)

    @cached_property
    def job_priority(self) -> DataFrame:
        return self._view(JOB_PRIORITY, pages=self.pages)

    @cached_property
    def scored(self) -> DataFrame:
        return self._view(SCORED, labels=self.labels)
